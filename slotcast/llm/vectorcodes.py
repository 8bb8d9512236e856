"""Vector codes: parts of vectors are replaced by the nearest entries of small codebooks, found through pivots."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotcast.llm.common import ship
from slotcast.llm.vectors import matrix
from slotcast.operators.sizing import lookup_side, settle
from slotcast.session import materialise, release

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
PIVOTS = 4
#: Components of this absolute value and more are left out, so that squared distances fit 64 bits.
LARGEST = 2.0**14
_CHUNK = 8192


def codable(vector: str, parts: int) -> Column:
    """Neither NULL nor with NULL, non-finite or too large components, and of a length that can be cut into the parts."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & ~bad, F.lit(False))


@dataclass(frozen=True)
class Codebooks:
    """Entries (part, entry, component) and the fixed pivots (part, pivot, component), all integers."""

    entries: np.ndarray
    pivots: np.ndarray

    @staticmethod
    def of(first: np.ndarray, parts: int, pivots: int) -> Codebooks:
        """Codebooks from integer vectors. The pivots of a part are those of its first entries that lie far from each other."""
        entries = first.reshape(len(first), parts, -1).transpose(1, 0, 2)
        chosen = []
        for part in entries:
            take = [0]
            far = squares(part, part[0])
            while len(take) < min(pivots, len(part)):
                take.append(int(far.argmax()))
                far = np.minimum(far, squares(part, part[take[-1]]))
            chosen.append(part[take])
        return Codebooks(entries, np.array(chosen))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows."""
    d = x - y
    return (d * d).sum(axis=-1)


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, entry_to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row (the lowest of equals), and the exact squared distance.

    A row and an entry are at least as far apart as their distances to a pivot differ. Entries are tried in the order of the largest such difference;
    a row is finished as soon as the next one's exceeds its best distance. A margin covers the rounding of the stored distances.
    """
    near, far = to_pivots[:, None, :], entry_to_pivots[None]
    least = (np.abs(near - far) - 1e-6 * (near + far)).max(axis=2)
    least = np.square(np.maximum(least, 0))
    order = np.argsort(least, axis=1, kind="stable")
    index = order[:, 0].copy()
    best = squares(x, entries[index])
    rows = np.arange(len(x))
    for tried in range(1, len(entries)):
        entry = order[rows, tried]
        open_ = least[rows, entry] <= best[rows]
        rows, entry = rows[open_], entry[open_]
        if not len(rows):
            break
        d = squares(x[rows], entries[entry])
        better = (d < best[rows]) | ((d == best[rows]) & (entry < index[rows]))
        best[rows[better]], index[rows[better]] = d[better], entry[better]
    return index, best


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance of each row of ``x`` to each row of ``y``."""
    return np.sqrt(squares(x[:, None, :], y[None]).astype(np.float64))


def _measurer(books: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Integer components and the distances of each part to its pivots, which no round changes."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK):
                rows = batch.slice(at, _CHUNK)
                x = np.floor(matrix(rows.column("vector")) * SCALE).astype(np.int64)
                cut = x.reshape(len(x), len(books.pivots), -1)
                far = np.concatenate([_distances(cut[:, p], pivots) for p, pivots in enumerate(books.pivots)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), rows.column("label"), _lists(x.astype(np.int32)), _lists(far.astype(np.float32))], ["id", "label", "whole", "far"]
                )

    return step


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def _assigned(batches: Iterator[pa.RecordBatch], books: Codebooks) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with their parts, the nearest entries and the squared distances."""
    parts = len(books.entries)
    between = [_distances(e, p) for e, p in zip(books.entries, books.pivots)]
    for batch in batches:
        for at in range(0, batch.num_rows, _CHUNK):
            rows = batch.slice(at, _CHUNK)
            x = rows.column("whole").flatten().to_numpy().astype(np.int64).reshape(rows.num_rows, parts, -1)
            far = rows.column("far").flatten().to_numpy().astype(np.float64).reshape(rows.num_rows, parts, -1)
            found = [nearest(x[:, p], far[:, p], books.entries[p], between[p]) for p in range(parts)]
            yield rows, x, np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _summer(books: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums and counts of the parts at each entry, one row for each entry of a task."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.entries.shape
        sums, counts = np.zeros((parts * entries, width), dtype=np.int64), np.zeros(parts * entries, dtype=np.int64)
        for _, x, index, _ in _assigned(batches, books):
            slot = (index + np.arange(parts) * entries).ravel()
            flat = x.reshape(-1, width)
            for k in range(width):  # a chunk's sums are below 2^53, so doubles hold them exactly
                sums[:, k] += np.bincount(slot, weights=flat[:, k], minlength=parts * entries).astype(np.int64)
            counts += np.bincount(slot, minlength=parts * entries)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), _lists(sums[used])], ["slot", "n", "sums"])

    return step


def _coder(books: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, index, distance in _assigned(batches, books):
            codes = [bytes(r).hex() for r in index.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("label"), pa.array(codes, pa.string()), pa.array(distance.sum(axis=1))], ["id", "label", "code", "error"])

    return step


def compress(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS
) -> tuple[DataFrame, Codebooks | None]:
    """``(id, label, code, error, label_error)`` of every codable vector, and the codebooks (None without rows).

    Components become ``floor(4096 x)``, vectors are cut into ``parts`` equal parts, and each part position has a codebook. It starts as that part of the ``entries``
    vectors of smallest id (equal ids: the smaller vector first; NULL ids last; fewer vectors give fewer entries). Each round puts every part to
    its nearest entry and replaces each entry by the component-wise floor of the mean; unused entries stay. ``code`` holds the final entries as two hex digits a part,
    ``error`` the squared distances, ``label_error`` their sum over equal labels, NULL ones together.

    Left out are vectors that are NULL, hold NULL or non-finite components or such of 2^14 and more, or whose length is not that of the vector of smallest id among those
    with a length that the parts divide. Repeated rows and ids count as rows of their own. Other columns are not read, whatever their names.

    Distances of parts to fixed pivots are stored once with the integer rows; in each round they order and rule out entries before any exact evaluation.
    A round is one pass that emits ``parts * entries`` sums a task, combined by Spark; only these sums, which do not grow with the table, reach the driver.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part, so a codebook has 1 to 256 entries")
    spark = ship(vectors.sparkSession)
    id_type, label_type = (vectors.schema[c].dataType.simpleString() for c in (id_column, label_column))
    rows = vectors.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{label_column}`").alias("label"), F.col(f"`{vector_column}`").cast("array<double>").alias("vector"))
    good = rows.where(codable("vector", parts))
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    length = good.orderBy(*order).select(F.size("vector")).head()
    if length is None:
        return spark.createDataFrame([], f"id {id_type}, label {label_type}, code string, error bigint, label_error bigint"), None
    good = good.where(F.size("vector") == length[0])
    first = np.array([r[0] for r in good.orderBy(*order).select("vector").take(entries)])
    books = Codebooks.of(np.floor(first * SCALE).astype(np.int64), parts, pivots)
    stored = materialise(good.mapInArrow(_measurer(books), f"id {id_type}, label {label_type}, whole array<int>, far array<float>"))
    for _ in range(rounds):
        sums = stored.mapInArrow(_summer(books), "slot bigint, n bigint, sums array<bigint>")
        totals = sums.select("slot", "n", F.posexplode("sums").alias("at", "x")).groupBy("slot", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        entries_now = books.entries.copy()
        flat = entries_now.reshape(-1, entries_now.shape[2])
        for slot, at, x, n in totals.collect():
            flat[slot, at] = x // n
        books = Codebooks(entries_now, books.pivots)
    coded = materialise(stored.mapInArrow(_coder(books), f"id {id_type}, label {label_type}, code string, error bigint"))
    release(stored)
    by_label, n = settle(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    joined = coded.join(lookup_side(by_label, n), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("id", "label", "code", "error", "label_error"), books
