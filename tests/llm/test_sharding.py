import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from slotcast.llm.sharding import locate, shard, write_shards


def bits(value):
    return f"{int(hashlib.md5(('' if value is None else str(value)).encode()).hexdigest()[:15], 16):060b}"


def plain(rows, limit):
    """Split whole bucket lists in memory."""
    out, todo = {}, [("", [(bits(k) + bits(t), s) for k, t, s in rows])]
    while todo:
        prefix, held = todo.pop()
        if held:
            if sum(s for _, s in held) <= limit or len({b for b, _ in held}) == 1:
                out[prefix] = sorted(s for _, s in held)
            else:
                d = len(prefix)
                for bit in "01":
                    todo.append((prefix + bit, [h for h in held if h[0][d] == bit]))
    return out


def run(spark, rows, limit):
    docs = spark.createDataFrame([(k, t, s, "x") for k, t, s in rows], "doc_id long, text string, size long, shard string")
    out = shard(docs, F.col("doc_id"), F.col("size"), F.col("text"), limit=limit).collect()
    got, pages = defaultdict(list), defaultdict(list)
    for r in out:
        assert len(r.shard) == r.depth
        got[r.shard].append(r.size)
        pages[r.shard, r.page].append(r.size)
    assert {k: sorted(v) for k, v in got.items()} == plain([(k, t, max(0, s or 0)) for k, t, s in rows], limit)
    assert all(sum(v) <= limit or len(v) == 1 for v in pages.values())
    assert sorted(map(repr, (r.id for r in out))) == sorted(map(repr, (k for k, _, _ in rows)))
    return pages


def test_shards_equal_plain_splitting(spark):
    run(spark, [(i, f"t{i}", (i * 37) % 90 + 1) for i in range(400)], 300)


def test_hot_key_and_equal_rows(spark):
    hot = [(7, f"t{i}", 20) for i in range(100)]
    same = [(8, "copy", 30)] * 90
    pages = run(spark, hot + same + [(i, "a", 10) for i in range(100, 200)], 100)
    assert max(page for _, page in pages) == 29


def test_edge_rows(spark):
    run(spark, [(None, None, None), (None, "", 0), (1, None, 500), (2, "x", 10), (2, "x", 10)], 100)
    run(spark, [], 100)


def test_written_shards_hold_their_rows_and_find_new_ones(spark, tmp_path):
    rows = [(i % 90, f"t{i % 200}", "x" * (i % 50), 777) for i in range(500)] + [(None, None, None, 1), (7, "same", "y" * 60, 2), (7, "same", "y" * 60, 2)]
    docs = spark.createDataFrame(rows, "`doc.id` long, text string, body string, size int")
    key, size, tie = F.col("`doc.id`"), F.octet_length("body"), F.col("text")
    directory = write_shards(docs, key, size, tie, f"{tmp_path}/out", limit=400)
    back = spark.read.option("basePath", f"{tmp_path}/out/rows").schema("`doc.id` long, text string, body string, size int, shard string, page long").parquet(f"{tmp_path}/out/rows")
    got = back.collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(rows, key=repr)
    held = defaultdict(int)
    for r in got:
        held[r.shard, r.page] += len(r.body or "")
    assert max(held.values()) <= 400 and len(held) > 20
    assert {(r.shard, r.rows) for r in directory.collect()} == {(s, sum(r.shard == s for r in got)) for s, _ in held}
    found = locate(docs, directory, key, tie).collect()
    assert sorted(((r["doc.id"], r.text, r.shard) for r in found), key=repr) == sorted(((r["doc.id"], r.text, r.shard) for r in got), key=repr)
    new = locate(spark.createDataFrame([(10_000 + i, "new", 1) for i in range(50)], "id long, text string, shard int"), directory, F.col("id"), F.col("text"))
    assert new.columns == ["id", "text", "shard", "_shard"]
    assert all(r["_shard"] is None or (bits(r.id) + bits(r.text)).startswith(r["_shard"]) for r in new.collect())


def test_an_empty_table_has_an_empty_directory(spark, tmp_path):
    docs = spark.createDataFrame([], "id long, text string")
    directory = write_shards(docs, F.col("id"), F.octet_length("text"), F.col("text"), f"{tmp_path}/none")
    assert directory.count() == 0
    some = spark.createDataFrame([(1, "a")], "id long, text string")
    assert [r.shard for r in locate(some, directory, F.col("id"), F.col("text")).collect()] == [None]
