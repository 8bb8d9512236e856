"""Forecast error measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _mean(pair_value: Column, strict: bool) -> Column:
    mean = F.avg(pair_value)
    return F.when(F.count(pair_value) == F.count(F.lit(1)), mean) if strict else mean


def error_metrics(df: DataFrame, predicted: str = "puissance", truth: str = "reality",
                  by: list[str] | None = None, strict: bool = True) -> DataFrame:
    """RMSE, MAPE (fraction) and MAE, with pair and zero-truth counts.

    ``strict`` gives NULL as soon as one pair is incomplete; otherwise such pairs are skipped.
    A truth of zero has no percentage error: it is left out of MAPE and counted.
    """
    gap = F.col(truth) - F.col(predicted)
    zero = F.col(truth) == 0
    share = F.abs(F.try_divide(gap, F.col(truth)))
    complete = F.count(gap) == F.count(F.lit(1))
    mape = F.avg(share)
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(_mean(gap * gap, strict)).alias("rmse"),
        (F.when(complete, mape) if strict else mape).alias("mape"),
        _mean(F.abs(gap), strict).alias("mae"),
        F.count_if(zero).alias("zero_truths"),
    )


def with_row_error(df: DataFrame, predicted: str = "puissance", truth: str = "reality", name: str = "mape") -> DataFrame:
    """Absolute percentage error of each row; NULL for a truth of zero."""
    gap = F.abs(F.col(predicted) - F.col(truth))
    return df.withColumn(name, F.try_divide(gap, F.abs(F.col(truth))) * 100)


def leaderboard(results: DataFrame, by: str = "scenario", metric: str = "mape") -> DataFrame:
    """Summary of a metric over repeats per scenario and its place; the best one has place 1.
    Results hold one row per scenario and repeat, so the groups are short."""
    quartile = [F.percentile(metric, F.lit(p)).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    summary = results.groupBy(by).agg(
        F.count(F.lit(1)).alias("repeats"), F.min(metric).alias("min"), *quartile,
        F.avg(metric).alias("mean"), F.max(metric).alias("max"),
    )
    return summary.withColumn("place", F.row_number().over(Window.orderBy("mean", by)))


def best(results: DataFrame, by: str = "scenario", metric: str = "mape") -> DataFrame:
    """One row: the scenario with the smallest mean of the metric."""
    means = results.groupBy(by).agg(F.avg(metric).alias("mean"))
    return means.agg(F.min_by(by, F.struct("mean", by)).alias(by), F.min("mean").alias("mean"))
