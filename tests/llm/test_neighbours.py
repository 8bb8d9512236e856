import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotcast.llm import neighbours
from slotcast.llm.neighbours import Quantised, products, search


def plain(rows, k, every):
    """Every pair of rows with different ids."""
    ok = [(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        found = []
        for i, v in ok:
            for o, w in ok:
                if i == q and o != q and len(v) == len(w):
                    d = 0.0
                    for a, b in zip(v, w):
                        step = float(np.float32(a)) - float(np.float32(b))
                        d += step * step
                    found.append((math.sqrt(d), o))
        out += [(q, r, o, d) for r, (d, o) in enumerate(sorted(found)[:k], 1)]
    return out


def check(spark, rows, k=5, every=10, **options):
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = search(frame, F.col("vec_id") % every == 0, k=k, **options).collect()
    assert sorted((r.query_id, r["rank"], r.id, r.score) for r in got) == plain(rows, k, every)


def test_results_equal_brute_force(spark):
    random = np.random.default_rng(3)
    check(spark, [(i, random.normal(size=9).tolist()) for i in range(200)])


def test_many_cells_and_ties(spark):
    random = np.random.default_rng(4)
    rows = [(i, random.integers(-2, 3, 4).astype(float).tolist()) for i in range(260)] + [(1000 + i, [1.0, 1.0, 0.0, 0.0]) for i in range(80)]
    check(spark, rows, k=10, cell_rows=50)


def test_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", (7, 11))
    random = np.random.default_rng(5)
    q, c = random.normal(size=(30, 6)), random.normal(size=(100, 6))
    heaps = neighbours.nearest(np.arange(30), q, np.arange(1000, 1100), c, 4)
    for i, heap in enumerate(heaps):
        d = np.sqrt(((q[i] - c) ** 2).sum(axis=1))
        assert sorted(-o for _, o in heap) == sorted(np.argsort(d)[:4] + 1000)


def test_bounds_hold():
    random = np.random.default_rng(6)
    a, b = random.normal(size=(40, 3000)) * random.exponential(size=(40, 1)), random.normal(size=(50, 3000))
    qa, qb = Quantised(a), Quantised(b)
    whole = products(qa.whole, qb.whole)
    assert (whole == qa.whole.astype(np.int64) @ qb.whole.astype(np.int64).T).all()
    error = qa.near[:, None] * qb.lost + qa.lost[:, None] * qb.length
    assert (np.abs(a @ b.T - whole * qa.step[:, None] * qb.step) <= error * (1 + 1e-9)).all()


def test_edge_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [5.0, 5.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (None, [1.0, 1.0])]
    rows += [(10, [2.0, 0.0]), (11, [1.0, 2.0, 3.0]), (20, [1.0, 2.0, 4.0]), (12, [4.0, 5.0]), (30, [float("inf"), 0.0])]
    check(spark, rows, k=10)
    check(spark, [])
    with pytest.raises(ValueError):
        search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.lit(True), k=0)


def test_repeated_ids_hide_no_candidates(spark):
    """Rows that share an id fill ranks one by one, as in the SQL; with fewer ranks than repeats too."""
    rows = [(0, [0.0, 1.0]), (1, [1.0, 1.0]), (1, [2.0, 1.0]), (1, [3.0, 1.0]), (2, [4.0, 1.0]), (3, [5.0, 1.0]), (4, [6.0, 1.0]), (10, [0.5, 1.0]), (10, [0.5, 1.0])]
    for k in (1, 2, 3, 5, 20):
        check(spark, rows, k=k)
        check(spark, rows, k=k, cell_rows=2)


def test_components_beyond_squares(spark):
    big = [(0, [1e200, 0.0]), (1, [1e200, 3e180]), (2, [-1e308, 1e308]), (3, [1e200, 1e170]), (4, [1.0, 2.0]), (10, [1e-200, 0.0]), (11, [1e-200, 2e-200]), (12, [1e-200, 5e-200])]
    frame = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in search(frame, F.col("vec_id") % 10 == 0, k=7).collect()}
    assert [got[0, r][0] for r in (1, 2)] == [3, 1] and got[0, 1][1] == pytest.approx(1e170) and got[0, 7] == (2, pytest.approx(math.sqrt(2) * 1e308))
    assert [got[10, r][0] for r in (1, 2, 3)] == [11, 12, 4] and got[10, 1][1] == pytest.approx(2e-200) and len(got) == 14
