import hashlib
import math

import numpy as np
import pytest

from slotcast.llm.queries import registered
from slotcast.llm.vectorcodes import Codebooks, compress, nearest

NAN, INF = math.nan, math.inf


def plain(rows, parts=8, entries=16, rounds=6):
    """``rows`` of (id, vector, label), by trying every entry; Python's whole numbers throughout."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[[math.floor(4096 * x) for x in v[p * len(v) // parts : (p + 1) * len(v) // parts]] for p in range(parts)] for _, v, _ in rows]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def found(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        chosen = [[found(p, c[p])[1] for c in cut] for p in range(parts)]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, at in zip(cut, chosen[p]) if at == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [[found(p, c[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in r) for r in last]
    total = {}
    for (_, _, label), e in zip(rows, error):
        total[label] = total.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in r), e, total[label]) for (i, _, label), r, e in zip(rows, last, error)], digest


def vectors(n, width, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return [[float(np.float32(x)) for x in v] for v in rng.normal(0, spread, (n, width))]


def result(coded):
    return sorted(((r.id, r.code, r.error, r.label_error) for r in coded.collect()), key=str)


def test_pruned_search_is_exact():
    rng = np.random.default_rng(4)
    for top in (3, 50, 1 << 26):
        x, e = rng.integers(-top, top, (700, 5)), rng.integers(-top, top, (16, 5))
        e[7] = e[3]
        pivots = e[[0, 5, 9]]
        far = [np.sqrt(((a[:, None] - pivots[None]) ** 2).sum(2).astype(float)) for a in (x, e)]
        index, best = nearest(x, far[0].astype(np.float32).astype(float), e, far[1])
        d = ((x[:, None] - e[None]) ** 2).sum(2)
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all()


def test_equals_plain_rounds(spark):
    rows = [(i, v, i % 3 or None) for i, v in enumerate(vectors(300, 16, 1))]
    coded, books = compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5))
    want, digest = plain(rows)
    assert result(coded) == sorted(want, key=str) and books.digest() == digest


def test_ties_copies_and_few_rows(spark):
    same = [0.5] * 8
    rows = [(3, same, "x"), (3, same, "x"), (1, [0.0] * 8, None), (None, [-1.5, 2.0] * 4, None), (2, [-0.0001] * 8, "y")] + [(9, [1.0, 2.0] * 4, "y")] * 40
    coded, books = compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))
    want, digest = plain(rows)
    assert result(coded) == sorted(want, key=str) and books.digest() == digest
    few, books = compress(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>, label string"))
    want, digest = plain(rows[:3])
    assert result(few) == sorted(want, key=str) and books.digest() == digest and books.entries.shape == (8, 3, 1)


def test_odd_rows_and_names(spark):
    good = [(i, v, 1) for i, v in enumerate(vectors(30, 8, 2))]
    odd = [(100, None, 1), (101, [None] + [1.0] * 7, 1), (102, [NAN] + [1.0] * 7, 1), (103, [1.0] * 7 + [-INF], 1), (104, [], 1), (105, [1.0] * 16, 1), (106, [1.0] * 7, 1), (107, [1e300] * 8, 1)]
    table = spark.createDataFrame([(i, v, k, 0, 0) for i, v, k in good + odd], "`my.id` long, embedding array<double>, label int, code int, far int")
    coded, _ = compress(table, "my.id")
    assert result(coded) == sorted(plain(good)[0], key=str)
    assert compress(table.where("`my.id` >= 100 and `my.id` <> 105"), "my.id")[0].collect() == [] and compress(table.limit(0), "my.id")[1] is None
    with pytest.raises(ValueError):
        compress(table, "my.id", entries=257)


def test_query_equals_plain_rounds(spark, tmp_path):
    rows = [(7 * i % 501, v, i % 4 or None) for i, v in enumerate(vectors(200, 64, 3, 0.1))] + [(999, None, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    want, digest = plain(rows[:-1])
    assert sorted(map(tuple, registered()["op13_vector_codes"](spark, str(tmp_path)).collect())) == sorted((*r, digest) for r in want)


def test_pivots_are_first_entries_far_apart():
    first = np.arange(32).reshape(16, 2) ** 2
    books = Codebooks.of(first, 2, 3)
    assert books.entries.shape == (2, 16, 1) and books.pivots[:, :2, 0].tolist() == [[0, 900], [1, 961]]
