import math

import numpy as np
import pytest

from slotcast.llm.embeddings import near_duplicates, plan

SCHEMA = "vec_id long, embedding array<float>, component long"


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def plain(rows, limit=0.9):
    n = len(rows)
    vectors = [np.array(v, np.float32).astype(float) if good(v) else None for _, v in rows]
    near = [[j for j in range(n) if j != i and vectors[i] is not None and vectors[j] is not None and len(vectors[i]) == len(vectors[j])
             and vectors[i] @ vectors[j] / (np.linalg.norm(vectors[i]) * np.linalg.norm(vectors[j])) >= limit] for i in range(n)]
    out, seen = [None] * n, set()
    for i in range(n):
        if i not in seen:
            todo, group = [i], set()
            while todo:
                x = todo.pop()
                if x not in group:
                    group.add(x)
                    todo += near[x]
            seen |= group
            ids = [rows[k][0] for k in group if rows[k][0] is not None]
            for k in group:
                out[k] = (rows[k][0], len(near[k]), min(ids) if ids else None)
    return sorted(out, key=repr)


def check(spark, rows, **options):
    got = near_duplicates(spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA), **options).collect()
    assert sorted(((r.id, r.n_links, r.component) for r in got), key=repr) == plain(rows)
    assert all(r.kept == ((r.id == r.component) if r.id is not None else r.n_links == 0) for r in got)


def clustered(n, seed, spread=0.25, size=16):
    random = np.random.default_rng(seed)
    centres = random.normal(size=(6, size))
    return [(i, (centres[i % 6] + spread * random.normal(size=size)).tolist()) for i in range(n)]


def test_links_equal_brute_force(spark):
    check(spark, clustered(150, 1))


def test_dense_buckets_are_cut_into_cells(spark):
    check(spark, clustered(180, 2, spread=0.1), block=10)


def test_edge_rows(spark):
    one = [1.0, 2.0, 0.5]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0])]
    rows += [(9, one), (8, one), (8, one), (None, one), (11, [2.0, 4.0, 1.0]), (12, [1.0, 2.0]), (13, [-1.0, -2.0, -0.5]), (None, [5.0, -1.0, 0.0])]
    check(spark, rows)
    check(spark, [])


def test_plan():
    for n in (0, 10, 1000, 10**6, 10**9):
        bits, tables = plan(n, 0.9)
        agree = (1 - math.acos(0.9) / math.pi) ** bits
        assert 1 - (1 - agree) ** tables >= 0.999 and 4 <= bits <= 30
    with pytest.raises(ValueError):
        plan(10, 0)
