"""Exact nearest neighbours of many queries: a block matrix join with 8-bit product tiles and error bounds."""

from __future__ import annotations

import math
from collections.abc import Callable
from heapq import heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotcast.llm.common import ship
from slotcast.llm.vectors import matrix, usable
from slotcast.session import materialise

#: Rows of a side of a cell; a task holds one cell.
CELL_ROWS = 16_384
TILE = (256, 2048)
#: Products of 8-bit numbers are exact in single precision up to so many components.
EXACT = (1 << 24) // (127 * 127)
#: Squares below this may have lost digits.
_LEAST = 1e-280


class Quantised:
    """Vectors as 8-bit numbers times a step, with the exact length of what is lost."""

    def __init__(self, x: np.ndarray) -> None:
        step = np.abs(x).max(axis=1) / 127
        step = np.maximum(step, np.finfo(float).tiny)
        self.whole = np.rint(x / step[:, None]).astype(np.int8)
        near = self.whole * step[:, None]
        lost = x - near
        self.step, self.square = step, (x * x).sum(axis=1)
        self.length, self.near, self.lost = np.sqrt(self.square), np.sqrt((near * near).sum(axis=1)), np.sqrt((lost * lost).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of 8-bit rows, through single-precision matrix products of as many components as stay exact."""
    total = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], EXACT):
        total += a[:, k : k + EXACT].astype(np.float32) @ b[:, k : k + EXACT].astype(np.float32).T
    return total


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of row pairs in double precision, components added in order. Where squares leave the range of doubles, the largest step is
    taken out first."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore"):
        for k in range(a.shape[1]):
            step = a[:, k] - b[:, k]
            total += step * step
        out = np.sqrt(total)
        odd = np.flatnonzero(~((total > _LEAST) & np.isfinite(total)))
        if len(odd):
            # halves, so that a difference stays finite
            step = np.abs(a[odd] / 2 - b[odd] / 2)
            top = step.max(axis=1)
            part = step / np.where(top > 0, top, 1)[:, None]
            out[odd] = np.where(top > 0, np.sqrt((part * part).sum(axis=1)) * top * 2, 0)
    return out


def nearest(q_id: np.ndarray, q: np.ndarray, c_id: np.ndarray, c: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """For every query row the ``k`` nearest candidate rows with another id, as heaps of (-distance, -id).

    A tile's quantised products bound each distance from both sides. A pair is computed exactly unless its lower bound is above
    the k-th upper bound of the tile or the k-th distance found so far; ties stay in, the smaller id wins. Bounds that leave the range of
    doubles rule out nothing.
    """
    heaps: list[list[tuple[float, int]]] = [[] for _ in q_id]
    worst = np.full(len(q_id), np.inf)
    with np.errstate(over="ignore", invalid="ignore"):
        return _tiles(q_id, q, c_id, c, k, heaps, worst)


def _tiles(q_id: np.ndarray, q: np.ndarray, c_id: np.ndarray, c: np.ndarray, k: int, heaps: list[list[tuple[float, int]]], worst: np.ndarray) -> list[list[tuple[float, int]]]:
    qq, cc = Quantised(q), Quantised(c)
    for s in range(0, len(q_id), TILE[0]):
        qs = slice(s, s + TILE[0])
        for t in range(0, len(c_id), TILE[1]):
            ct = slice(t, t + TILE[1])
            dot = products(qq.whole[qs], cc.whole[ct]) * qq.step[qs, None] * cc.step[None, ct]
            error = qq.near[qs, None] * cc.lost[None, ct] + qq.lost[qs, None] * cc.length[None, ct]
            squares = qq.square[qs, None] + cc.square[None, ct]
            error += 1e-12 * squares
            error += _LEAST
            low, high = squares - 2 * (dot + error), squares - 2 * (dot - error)
            unknown = ~(np.isfinite(low) & np.isfinite(high))
            low[unknown], high[unknown] = -np.inf, np.inf
            own = q_id[qs, None] == c_id[None, ct]
            low[own], high[own] = np.inf, np.inf
            limit = worst[qs] ** 2 * (1 + 1e-12) + _LEAST
            if high.shape[1] > k:
                limit = np.minimum(limit, np.partition(high, k - 1, axis=1)[:, k - 1])
            a, b = np.nonzero((low <= limit[:, None]) & ~own)
            exact = np.concatenate([distances(q[a[p : p + 65536] + s], c[b[p : p + 65536] + t]) for p in range(0, len(a), 65536)]) if len(a) else np.zeros(0)
            for row, d, other in zip((a + s).tolist(), exact.tolist(), c_id[b + t].tolist()):
                heap = heaps[row]
                if len(heap) < k:
                    heappush(heap, (-d, -other))
                elif (-d, -other) > heap[0]:
                    heappushpop(heap, (-d, -other))
                if len(heap) == k:
                    worst[row] = -heap[0][0]
    return heaps


def _cell(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def step(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            heaps, ids = [], []
        else:
            ids = queries.column("q").to_numpy()
            heaps = nearest(ids, matrix(queries.column("vector")), rows.column("id").to_numpy(), matrix(rows.column("vector")), k)
        found = [(int(i), -other, -d) for i, heap in zip(ids, heaps) for d, other in heap]
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "id", "score"])

    return step


def search(rows: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(query_id, rank, id, score)``: for every id of a row that ``is_query`` holds for, the ``k`` rows of other ids at the smallest Euclidean
    distance, nearest first, ties to the smaller id; all of them if there are fewer. The result is exact.

    Rows whose vector is NULL, empty, zero or not finite take no part, nor do rows without an id; vectors of different
    lengths do not meet. Every row counts: rows that share an id, equal ones too, are so many candidates, and a query id with several rows has the
    ``k`` best pairs of them all. Only rows with the query's own id are no candidates. Distances beyond the range of doubles are infinite.

    Queries and rows are dealt by hash into parts of about ``cell_rows``; each pair of parts is one cell, worked off in tiles by one
    task that keeps a heap per query. The heaps of a query's cells, ``k`` rows each, are merged by a window.
    """
    if k < 1:
        raise ValueError("k must be positive")
    ship(rows.sparkSession)
    good = rows.where(usable(vector_column) & F.col(f"`{id_column}`").isNotNull())
    base = materialise(good.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector_column}`").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("_query"), F.monotonically_increasing_id().alias("_row")))
    sizes = base.agg(F.count("*").alias("rows"), F.sum(F.col("_query").cast("long")).alias("queries")).first()
    across, down = (max(1, math.ceil((sizes[c] or 0) / cell_rows)) for c in ("rows", "queries"))
    # numbered in the written table's files, so that copies of one row are spread too
    spread = F.xxhash64("id", "vector", "_row")
    queries = base.where("_query").select(
        F.col("id").alias("q"), "vector", F.size("vector").alias("dim"), F.pmod(spread, F.lit(down)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("j")
    )
    others = base.select(
        "id", "vector", F.size("vector").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("i"), F.pmod(spread, F.lit(across)).cast("int").alias("j")
    )
    found = queries.groupBy("dim", "i", "j").cogroup(others.groupBy("dim", "i", "j")).applyInArrow(_cell(k), "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
