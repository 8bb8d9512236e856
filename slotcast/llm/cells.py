"""Compare the rows of a bucket in cells of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.session import materialise

CELL = ["_i", "_j"]
SMALL = 32


def cut(keyed: DataFrame, keys: list[str], spread: str, block: int, rare: bool = True) -> DataFrame:
    """Cut the buckets named by ``keys`` into cells.

    A bucket of n rows is cut into ceil(n / block) parts by a hash of ``spread``; cell (i, j) holds parts i and j,
    so that every pair of rows meets in one cell and no task ever holds more than one cell. If ``rare``, most buckets are taken to
    have one row, and these go before rows are shuffled; else only buckets of more than ``block`` rows are looked up, which are few.
    """
    # written, so that both sides of the join are shuffled for it and a hot bucket can be split
    sizes = materialise(keyed.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > (1 if rare else block)))
    parts = F.ceil(F.coalesce("_n", F.lit(1)) / F.lit(block)).cast("int")
    return (
        keyed.join(sizes, keys, "inner" if rare else "left")
        .withColumn("_parts", parts)
        .withColumn("_part", F.pmod(F.xxhash64(spread), F.col("_parts").cast("long")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .withColumn("_i", F.least("_part", "_other"))
        .withColumn("_j", F.greatest("_part", "_other"))
        .drop("_n", "_parts", "_other")
    )


def arranged(cells: DataFrame, keys: list[str], then: list[str] | None = None) -> DataFrame:
    """Rows of cells, sorted so that a cell's rows follow each other, by part and the columns ``then``."""
    order = [*keys, *CELL]
    return cells.repartition(*order).sortWithinPartitions(*order, "_part", *(then or []))


def deal(keyed: DataFrame, keys: list[str], spread: str, block: int, rare: bool = True) -> DataFrame:
    """:func:`cut` and :func:`arranged`."""
    return arranged(cut(keyed, keys, spread, block, rare), keys)


def bounds(columns: list[np.ndarray]) -> np.ndarray:
    """Start of every run of equal rows, and the number of rows."""
    n = len(columns[0])
    change = np.zeros(n, dtype=bool)
    change[:1] = True
    for v in columns:
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), n)


def meetings(at: np.ndarray, part: np.ndarray, cross: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Position pairs of all cells: one pair of arrays per distance for the small cells, blocks for the others.

    ``cross`` tells for each cell whether only pairs of different parts are wanted.
    """
    size = np.diff(at)
    small = size <= SMALL
    end = np.repeat(at[1:], size)
    apart = np.repeat(cross, size)
    here = np.flatnonzero(np.repeat(small, size))
    for d in range(1, SMALL):
        here = here[here + d < end[here]]
        if not len(here):
            break
        good = ~apart[here] | (part[here] != part[here + d])
        yield here[good], here[good] + d
    for c in np.flatnonzero(~small):
        low, high = int(at[c]), int(at[c + 1])
        if cross[c]:
            mid = low + int(np.searchsorted(part[low:high], part[high - 1]))
            left, right = np.arange(low, mid), np.arange(mid, high)
        else:
            left = right = np.arange(low, high)
        for k in range(0, len(left), 256):
            a, b = np.meshgrid(left[k : k + 256], right, indexing="ij")
            a, b = a.ravel(), b.ravel()
            if not cross[c]:
                a, b = a[a < b], b[a < b]
            yield a, b
