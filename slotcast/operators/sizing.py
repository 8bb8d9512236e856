"""Broadcast only what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.session import materialise

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
#: Memory that a byte of a compressed file can take.
UNPACKED = 8


def stored_bytes(table: DataFrame) -> int:
    """Bytes of the written files of a materialised table, unpacked; of other frames what the optimizer knows from its files."""
    path = getattr(table, "stored_at_", None)
    if path is None:
        return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    spark = table.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return UNPACKED * place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def settle(small: DataFrame) -> tuple[DataFrame, int]:
    """Materialise a fitted table and count it."""
    table = materialise(small)
    return table, table.count()


def lookup_side(table: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast for a counted table whose measured size fits; otherwise leave the join to
    Spark, which shuffles both sides and splits skewed partitions."""
    small = rows <= BROADCAST_ROWS and stored_bytes(table) <= BROADCAST_BYTES
    return F.broadcast(table) if small else table
