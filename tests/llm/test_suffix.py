import random
from collections import defaultdict

import pytest

from slotcast.llm.suffix import cut, repeated_passages, without_repeats

SCHEMA = "doc_id long, text string"


def plain(rows, size):
    """Every window with an equal one, and the first of them."""
    at = defaultdict(set)
    for i, text in set(rows):
        w = (text or "").encode().split()
        for k in range(len(w) - size + 1):
            at[tuple(w[k : k + size])].add((i, k))
    return {x: min(v, key=lambda x: (x[0] is not None, x)) for v in at.values() if len(v) > 1 for x in v}


def windows(found, size):
    out = {}
    for r in found:
        assert r.n_words >= size and r.kept == ((r.id, r.start) == (r.first_id, r.first_start))
        for k in range(r.n_words - size + 1):
            assert (r.id, r.start + k) not in out
            out[r.id, r.start + k] = (r.first_id, r.first_start + k)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_passages_equal_brute_force(spark, seed):
    source = random.Random(seed)
    rows = []
    for i in range(60):
        if rows and source.random() < 0.6:
            a, b = (source.choice(rows)[1].split() for _ in range(2))
            w = a[source.randrange(len(a) + 1) :] + b[: source.randrange(len(b) + 1)]
            for _ in range(source.randrange(3)):
                if w:
                    w[source.randrange(len(w))] = source.choice("xyz")
        else:
            w = [source.choice("abcdefgh") for _ in range(source.randrange(60))]
        rows.append((i, " ".join(w)))
    found = repeated_passages(spark.createDataFrame(rows, SCHEMA), min_words=8, gram=3).collect()
    assert windows(found, 8) == plain(rows, 8)


def test_edge_rows(spark):
    words = " ".join(f"w{i}" for i in range(70))
    rows = [(1, None), (2, ""), (3, "short"), (4, "To " * 120), (5, words), (6, "x " + words), (6, "x " + words), (None, words + " y"), (8, "a " * 3_000)]
    found = repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert windows(found, 50) == plain(rows, 50)
    assert {r.id for r in found} == {4, 5, 6, 8, None}
    assert repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fifty_words_and_not_one_less(spark):
    passage = [f"p{i}" for i in range(50)]
    rows = [(1, " ".join(["a", *passage, "b"])), (2, " ".join(["c", *passage, "d"])), (3, " ".join(["e", *passage[:49], "f"]))]
    found = repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.id, r.start, r.n_words, r.first_id, r.kept) for r in found) == [(1, 1, 50, 1, True), (2, 1, 50, 1, False)]


def test_cut_keeps_first_occurrences():
    cuts = [{"start": 1, "n_words": 3, "kept": False}, {"start": 3, "n_words": 2, "kept": True}]
    assert cut("  a b\nc  d e f ", cuts) == "  a d e f "
    assert cut("a b", []) == "a b" and cut(None, cuts) is None


def test_texts_without_later_occurrences(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"one {passage} two", "_v"), (2, f"three {passage} four", None), (3, passage, "k"), (4, "", None), (5, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, version string")
    out = without_repeats(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, f"one {passage} two", "_v"), (2, "three four", None), (4, "", None), (5, None, "n")]


def test_any_column_names(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    names = ["_v", "_id", "_cuts", "_text", "a.b", "c0"]
    docs = spark.createDataFrame([(1, f"one {passage} two", *[777] * 6), (2, f"three {passage} four", *[777] * 6)], ["doc_id", "text", *names])
    out = without_repeats(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, f"one {passage} two", *[777] * 6), (2, "three four", *[777] * 6)]


def test_texts_without_cuts_are_not_shuffled(spark, plan):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"own{i} {passage} end{i}") for i in range(5)] + [(10 + i, " ".join(f"o{i}w{k}" for k in range(80))) for i in range(200)]
    out = without_repeats(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, out.collect())) == [rows[0], *((i, f"own{i} end{i}") for i in range(1, 5)), *rows[5:]]
    # the side behind the texts with cuts: a filter of the texts' own hashes, and no exchange by key
    sides = plan(out).split("Union")
    assert len(sides) > 1 and "BroadcastHashJoin" in sides[-1]
    assert "Exchange hashpartitioning" not in sides[-1][sides[-1].rindex("BroadcastHashJoin"):]
