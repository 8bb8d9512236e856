"""Dictionaries of levels as written tables, numbered without a driver list or a one-task sort."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.functions.quoting import name
from slotcast.operators.position import with_position
from slotcast.operators.sizing import lookup_side, settle


@dataclass(frozen=True)
class Dictionary:
    """``(level, index)`` rows of a variable, counted; indexes run from 0."""

    table: DataFrame
    levels: int

    def index(self, df: DataFrame, column: str, out: str) -> DataFrame:
        """``df`` with the index of each value in ``out``; NULL for NULL and for levels that are not in the dictionary.

        A dictionary beyond the broadcast limits is joined by a shuffle, in which adaptive execution splits a hot level.
        """
        side = lookup_side(self.table.select(F.col("level").alias("level_"), F.col("index").alias(out)), self.levels)
        joined = df.alias("rows").join(side.alias("known"), F.expr(f"rows.{name(column)} = known.level_"), "left")
        return joined.selectExpr(*[f"rows.{name(c)}" for c in df.columns if c != out], f"known.{name(out)}")


def sorted_levels(df: DataFrame, column: str, as_text: bool = False) -> Dictionary:
    """The known values of a column in their order, of their own type or as text.

    Distinct values are combined before the shuffle, range-partitioned and written; a value's index is its place in its file plus the rows of the files
    before. No task holds more than its range, however many levels there are. Without known values the dictionary is empty.
    """
    value = F.col(name(column)).cast("string") if as_text else F.col(name(column))
    return _numbered(df.select(value.alias("level")).where("level IS NOT NULL").distinct(), "level", [])


def levels_in_order_seen(df: DataFrame, column: str, time: str) -> Dictionary:
    """The known values of a column in the order of their first ``time``; values first seen at one time in their own order, those never
    seen with a time first."""
    value = F.col(name(column)).alias("level")
    seen = df.select(value, F.col(name(time)).alias("time_")).where("level IS NOT NULL").groupBy("level").agg(F.min("time_").alias("seen_"))
    return _numbered(seen, "seen_", ["level"])


def _numbered(levels: DataFrame, first: str, ties: list[str]) -> Dictionary:
    placed = with_position(levels, ties, first, "index")
    return Dictionary(*settle(placed.select("level", "index")))
