"""Renaming, duplicate removal, time bounds, missing-row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rename_by_position(df: DataFrame, names: list[str]) -> DataFrame:
    if len(names) != len(df.columns):
        raise ValueError(f"{len(df.columns)} columns, {len(names)} names")
    return df.toDF(*names)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Keep one of each set of equal rows. Copies collapse before the shuffle, so a row
    that makes up a large part of the table costs one row per input partition."""
    return df.dropDuplicates()


def duplicate_counts(df: DataFrame) -> DataFrame:
    """One row: rows in, rows kept, rows removed."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))
    return copies.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).cast("bigint").alias("rows_in"),
        F.count(F.lit(1)).alias("rows_kept"),
        (F.coalesce(F.sum("copies"), F.lit(0)) - F.count(F.lit(1))).cast("bigint").alias("rows_removed"),
    )


def until(df: DataFrame, bound: str, time: str = "datetime") -> DataFrame:
    """Rows up to and including a time bound."""
    return df.filter(F.col(time) <= F.lit(bound).cast("timestamp"))


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where all of the columns are known."""
    return df.dropna(subset=list(columns))


def numeric_columns(df: DataFrame, among: list[str] | None = None) -> list[str]:
    """Names of the numeric columns, in order; others are left out without an error."""
    from pyspark.sql.types import NumericType

    wanted = df.columns if among is None else among
    return [c for c in wanted if isinstance(df.schema[c].dataType, NumericType)]
