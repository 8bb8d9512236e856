import hashlib
import random
import zlib

import numpy as np
import pytest

from slotcast.llm.periods import collapsed, grouped, lce, periodic_runs, word_runs
from slotcast.llm.queries import registered

LEAST = ((24, 3), (1, 3), (5, 3), (7, 4))


def plain_lyndon(s):
    """Longest Lyndon prefix of every suffix, by comparing suffixes."""
    return [next((j for j in range(i + 1, len(s)) if s[j:] <= s[i:]), len(s)) - i for i in range(len(s))]


def plain_runs(w, min_words, min_periods):
    """Every stretch that equals itself one period on, without those that have a smaller period."""
    found = []
    for q in range(1, len(w) // min_periods + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - start + q
            if i > start and n >= max(min_words, min_periods * q) and not any(w[start : start + n - d] == w[start + d : start + n] for d in range(1, q)):
                found.append((start, n, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def mixed_words(rng):
    kinds, out = rng.randint(1, 4), []
    for _ in range(rng.randint(0, 8)):
        root = [b"w%d" % rng.randrange(kinds) for _ in range(rng.randint(1, 13))]
        out += (root * 70)[: rng.choice([len(root), rng.randint(1, 70)])]
    return out


def test_groups_are_lyndon_prefixes():
    rng = random.Random(1)
    for _ in range(1500):
        s = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 24))]
        s = [sorted(set(s)).index(v) for v in s]
        for ranks in (s, [max(s) - v for v in s] if s else []):
            group, length = grouped(ranks)
            assert length == plain_lyndon(ranks)
            words = {}
            assert all(words.setdefault(g, ranks[i : i + n]) == ranks[i : i + n] for i, (g, n) in enumerate(zip(group, length)))
            assert len(set(map(tuple, words.values()))) == len(words)


def test_common_extensions():
    rng = random.Random(2)
    for _ in range(300):
        a = np.array([rng.randrange(2) if rng.random() < 0.05 else 0 for _ in range(rng.randint(1, 120))])
        i, j = rng.randrange(len(a)), rng.randrange(len(a))
        assert lce(a, i, j) == next((k for k in range(len(a) - max(i, j)) if a[i + k] != a[j + k]), len(a) - max(i, j))
        assert lce(a, i, j, -1) == next((k for k in range(min(i, j) + 1) if a[i - k] != a[j - k]), min(i, j) + 1)


@pytest.mark.parametrize("least", LEAST)
def test_runs_equal_brute_force(least):
    rng = random.Random(sum(least))
    found = 0
    for _ in range(500):
        words = mixed_words(rng)
        want = plain_runs(words, *least)
        assert word_runs(words, *least) == want
        found += len(want)
    assert found > 200


def test_strings_with_most_runs():
    fibonacci, shorter = [b"a"], [b"b"]
    while len(fibonacci) < 600:
        fibonacci, shorter = fibonacci + shorter, fibonacci
    for words in (fibonacci, [b"a"] * 500, [b"%d" % (i % 97) for i in range(700)], [b"%d" % (bin(i).count("1") % 2) for i in range(600)]):
        assert word_runs(words) == plain_runs(words, 24, 3)


def test_collapsed_words():
    words = [b"x"] + [b"a", b"b"] * 15 + [b"y"]
    assert collapsed(words, word_runs(words)) == b"x a b y"
    assert collapsed([], []) == b""


def test_odd_rows_and_names(spark):
    loop = "go on " * 20
    rows = [(1, None, 7), (2, "", 7), (3, " \n\t", 7), (None, loop, 7), (4, loop, 7), (4, loop, 7), (5, "é" * 100_000, 7), (6, "à b c " * 40_000, 7), (7, "one two three", 7)]
    docs = spark.createDataFrame(rows, "`my.id` long, text string, runs int")
    got = sorted(((r.id, r.n_words, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.collapsed) for r in periodic_runs(docs, "my.id").collect()), key=str)
    run = [(0, 40, 2)]
    want = [(1, 0, [], None, ""), (2, 0, [], None, ""), (3, 0, [], None, ""), (None, 40, run, run[0], "go on"), (4, 40, run, run[0], "go on"), (4, 40, run, run[0], "go on"),
            (5, 1, [], None, "é" * 100_000), (6, 120_000, [(0, 120_000, 3)], (0, 120_000, 3), "à b c"), (7, 3, [], None, "one two three")]
    assert got == sorted(want, key=str)
    assert periodic_runs(docs.limit(0), "my.id").collect() == []
    with pytest.raises(ValueError):
        periodic_runs(docs, "my.id", min_periods=2)


def plain_document(doc_id, text):
    """The contract's columns for one document, by brute force."""
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words, 24, 3)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    digest = [hashlib.sha256(x).hexdigest() for x in (b"".join(b"%d,%d,%d\n" % r for r in found), b" ".join(w for i, w in enumerate(words) if i not in gone))]
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digest)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(5)
    texts = ["".join(w.decode() + rng.choice(" \n\t") for w in mixed_words(rng)) for _ in range(300)] + [None, "", "one", " a  b\r\n" * 30]
    spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, h int").write.parquet(f"{tmp_path}/documents.parquet")
    got = registered()["op11_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [plain_document(i, t) for i, t in enumerate(texts)]
