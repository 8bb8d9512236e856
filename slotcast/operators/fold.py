"""Fold an hourly series into slots with deltas, and unfold it again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotcast.fixed import SLOT_HOURS
from slotcast.functions.quoting import name
from slotcast.functions.stamps import shift_hours, slot_offset, slot_start


def fold_hourly(
    df: DataFrame,
    value: str = "puissance",
    time: str = "datetime",
    slot_hours: int = SLOT_HOURS,
    on_duplicate: str = "error",
    keep_levels: bool = False,
    order: str | None = None,
) -> DataFrame:
    """One row per slot: P0, the deltas DP1, DP2 to it and, between the last two, DP12.

    A missing hour leaves NULL. ``on_duplicate`` says what two rows of one hour mean:
    ``error``, ``mean``, or ``first`` (by the ``order`` column, which should be unique). ``keep_levels`` adds P1, P2...
    """
    stamp = F.col(time)
    # every level looks at the counts of all hours: selecting some of them can not hide a duplicate
    most = F.greatest(*[F.count(F.when(slot_offset(stamp, slot_hours) == k, 1)) for k in range(slot_hours)], F.lit(0))
    aggregates: list[Column] = []
    for k in range(slot_hours):
        here = slot_offset(stamp, slot_hours) == k
        seen = F.when(here, F.col(value))
        if on_duplicate == "mean":
            level = F.avg(seen)
        elif on_duplicate == "first":
            if order is None:
                raise ValueError("on_duplicate='first' needs an order column")
            level = F.min_by(F.col(value), F.when(here, F.col(order)))
        elif on_duplicate == "error":
            level = F.when(most > 1, F.raise_error(F.lit("an hour of a slot occurs more than once"))).otherwise(F.max(seen))
        else:
            raise ValueError("on_duplicate is 'error', 'mean' or 'first'")
        aggregates.append(level.alias(f"P{k}"))
    slots = df.groupBy(slot_start(stamp, slot_hours).alias(time)).agg(*aggregates)
    return with_deltas(slots, slot_hours, keep_levels)


def with_deltas(slots: DataFrame, slot_hours: int = SLOT_HOURS, keep_levels: bool = False) -> DataFrame:
    """Replace the levels P1, P2... by their distance to P0 (and P2 to P1 as DP12)."""
    deltas = {f"DP{k}": F.col(f"P{k}") - F.col("P0") for k in range(1, slot_hours)}
    if slot_hours == 3:
        deltas["DP12"] = F.col("P2") - F.col("P1")
    out = slots.withColumns(deltas)
    return out if keep_levels else out.drop(*[f"P{k}" for k in range(1, slot_hours)])


def level_columns(chained: bool = False) -> list[Column]:
    """P0, P1, P2 from P0 and deltas: P1 = P0 + DP1, P2 = P0 + DP2, or P2 = P1 + DP12 if chained."""
    p1 = F.col("P0") + F.col("DP1")
    p2 = p1 + F.col("DP12") if chained else F.col("P0") + F.col("DP2")
    return [F.col("P0"), p1.alias("P1"), p2.alias("P2")]


def recompose(df: DataFrame, chained: bool = False) -> DataFrame:
    """Levels in place of deltas, as :func:`level_columns` makes them."""
    _, p1, p2 = level_columns(chained)
    return df.withColumns({"P1": p1, "P2": p2}).drop("DP1", "DP2", "DP12")


def unfold(
    df: DataFrame,
    levels: list[str] | None = None,
    time: str = "datetime",
    value: str = "puissance",
    keep: list[str] | None = None,
) -> DataFrame:
    """Slots back to hours: one row per slot and level ``Pk``, k hours after the slot start."""
    levels = levels or [f"P{k}" for k in range(SLOT_HOURS)]
    keep = keep or []
    long = df.select(time, *keep, *levels).unpivot([time, *keep], levels, "variable", value)
    hour = F.substring(F.col("variable"), 2, 2).cast("int")
    return long.select(shift_hours(F.col(time), hour).alias(time), *keep, value)


def labelled_rows(slots: DataFrame, targets: list[str], ids: list[str]) -> DataFrame:
    """The rows each target's model may learn from: ``target`` and its known ``label``."""
    return unpivot_measures(slots, ids, targets, "target", "label").filter("label IS NOT NULL")


def unpivot_measures(
    df: DataFrame, ids: list[str], measures: list[str], variable: str = "variable", value: str = "value"
) -> DataFrame:
    wide = df.selectExpr(*[name(c) for c in ids], *[f"double({name(c)}) AS {name(c)}" for c in measures])
    return wide.unpivot(ids, measures, variable, value)
