"""Near-duplicate vectors: random-hyperplane hashing in several tables, exact cosine, connected components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.llm.cells import CELL, bounds, deal
from slotcast.llm.common import runs, ship
from slotcast.llm.components import components, local_roots
from slotcast.llm.vectors import matrix, usable
from slotcast.session import materialise

RECALL = 0.999
BUCKET = 24
BLOCK = 1024
TABLES_A_PASS = 12
_PAIRS = 1 << 15


def plan(n: int, cosine: float, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """Bits and number of tables: chance alone puts about ``bucket`` of ``n`` vectors together, and a pair with just the wanted
    cosine meets in some table with probability ``recall``; nearer pairs with more."""
    if not 0 < cosine <= 1 or not 0 < recall < 1:
        raise ValueError("cosine must be in (0, 1] and recall in (0, 1)")
    bits = min(30, max(4, round(math.log2(max(n, 1) / bucket)) if n > bucket else 4))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, 1 if agree >= recall else math.ceil(math.log(1 - recall) / math.log(1 - agree))


def _coder(bits: int, tables: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes).tolist():
                rows = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).normal(size=(dim, bits * tables))
                side = matrix(rows.column("vector")) @ planes[dim] > 0
                codes = side.reshape(len(side), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables, dtype=np.int32)), pa.array(codes.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([rows.column("node"), rows.column("copies"), rows.column("dim"), rows.column("vector"), flat], ["node", "copies", "dim", "vector", "codes"])

    return step


def _linker(cosine: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of each cell, every pair only in the first table in which it meets: ``(a, NULL, n)`` adds n links to node a,
    ``(a, b, 0)`` is an edge of a spanning forest."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["dim", "table", "code", *CELL]):
            dim, table, code, i, j, part, node, copies = (rows.column(c).to_numpy() for c in ("dim", "table", "code", *CELL, "_part", "node", "copies"))
            at = bounds([dim, table, code, i, j])
            codes = rows.column("codes").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
            links, left, right = np.zeros(len(node), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            vectors = rows.column("vector").combine_chunks()
            for c in range(len(at) - 1):
                low, high = int(at[c]), int(at[c + 1])
                x = matrix(vectors.slice(low, high - low))
                length = np.sqrt((x * x).sum(axis=1))
                cut = int(np.searchsorted(part[low:high], part[high - 1])) if i[low] != j[low] else 0
                for start in range(0, cut or high - low, 256):
                    end = min(start + 256, cut or high - low)
                    near = x[start:end] @ x[cut:].T / (length[start:end, None] * length[None, cut:])
                    a, b = np.nonzero(near >= cosine)
                    a, b = a + start, b + cut
                    if not cut:
                        a, b = a[a < b], b[a < b]
                    for k in range(0, len(a), _PAIRS):
                        p, q = a[k : k + _PAIRS] + low, b[k : k + _PAIRS] + low
                        first = ~(codes[p, : table[low]] == codes[q, : table[low]]).any(axis=1)
                        p, q = p[first], q[first]
                        np.add.at(links, p, copies[q])
                        np.add.at(links, q, copies[p])
                        left.append(p)
                        right.append(q)
                if sum(map(len, left)) > 1 << 20:  # a dense cell: only its forest is kept
                    root = local_roots(len(node), np.concatenate(left), np.concatenate(right))
                    moved = np.flatnonzero(root != np.arange(len(root)))
                    left, right = [moved], [root[moved]]
            root = local_roots(len(node), np.concatenate(left), np.concatenate(right))
            moved, linked = np.flatnonzero(root != np.arange(len(root))), np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([node[linked], node[moved]])), pa.array(np.concatenate([np.zeros(len(linked), np.int64), node[root[moved]]]), mask=np.arange(len(linked) + len(moved)) < len(linked)),
                 pa.array(np.concatenate([links[linked], np.zeros(len(moved), np.int64)]))],
                ["a", "b", "n"],
            )

    return step


def near_duplicates(
    rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = 0.9, recall: float = RECALL, block: int = BLOCK, seed: int = 5
) -> DataFrame:
    """``(id, n_links, component, kept)`` for every row.

    Two rows are linked if their cosine in double precision is at least ``cosine`` and hashing brings them together, which for a
    pair at the limit has probability ``recall``. Equal vectors are one node with a number of copies. ``component`` is the smallest id that
    links reach, ``kept`` whether it is the row's own. Rows whose vector is NULL, empty, zero or not finite, and vectors
    of other lengths, link with nothing; a NULL id is never the smallest, and such a row is kept only if it is alone.

    Buckets are compared in cells of bounded size; a cell gives link counts and a spanning forest, not its pairs. A few
    tables are worked off in a pass, so only so many copies of the vectors are on disk at a time.
    """
    ship(rows.sparkSession)
    kind = rows.schema[vector_column].dataType.simpleString()
    all_rows = rows.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector")).withColumn("_good", usable("vector"))
    classes = materialise(
        all_rows.where("_good").groupBy("vector").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
        .select("vector", "copies", "least", F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("node"))
    )
    bits, tables = plan(classes.count(), cosine, recall)
    coded = materialise(classes.select("node", "copies", "dim", "vector").mapInArrow(_coder(bits, tables, seed), f"node long, copies long, dim int, vector {kind}, codes array<int>"))
    found = []
    for start in range(0, tables, TABLES_A_PASS):
        some = F.posexplode(F.slice("codes", start + 1, TABLES_A_PASS)).alias("table", "code")
        keyed = coded.select("node", "copies", "dim", "vector", "codes", some).withColumn("table", F.col("table") + start)
        cells = deal(keyed, ["dim", "table", "code"], "node", block)
        found.append(materialise(cells.select("dim", "table", "code", *CELL, "_part", "node", "copies", "vector", "codes").mapInArrow(_linker(cosine), "a long, b long, n long")))
    found = reduce(DataFrame.union, found)
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    roots = components(found.where("b is not null").select("a", "b").distinct())
    named = materialise(
        classes.select("node", "copies", "least", "vector").join(links, "node", "left").join(roots, "node", "left")
        .select("node", "vector", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "node").alias("root"))
    )
    lowest = materialise(named.groupBy("root").agg(F.min("least").alias("lowest")))
    by_vector = named.join(lowest, "root").select(F.col("vector").alias("_vector"), "links", "lowest")
    joined = all_rows.select("id", F.when(F.col("_good"), F.col("vector")).alias("_own")).join(by_vector, F.col("_own") == F.col("_vector"), "left")
    component = F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("lowest"))
    return joined.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component")).withColumn(
        "kept", F.when(F.col("id").isNull(), F.col("n_links") == 0).otherwise(F.col("id") == F.col("component"))
    )
