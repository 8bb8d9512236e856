"""The tables behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.functions.calendar import with_calendar
from slotcast.operators.fold import unpivot_measures


def forecast_chart(hourly: DataFrame, predicted: str = "puissance", truth: str = "reality") -> DataFrame:
    """Prediction and truth by hour, with the day's panel label."""
    return hourly.select(
        "datetime", F.hour("datetime").alias("hour"),
        F.date_format("datetime", "MMM-dd-(EEE)").alias("panel"), predicted, truth,
    )


def load_chart(load: DataFrame, value: str = "puissance") -> DataFrame:
    """Load by day of month, one line per hour, one panel per year and month."""
    return with_calendar(load).select("Year", "Month", "Day", "Hour", value)


def measure_chart(weather: DataFrame, measures: list[str]) -> DataFrame:
    """Each measure by day (training period) or by hour (forecast period): the same rows serve both."""
    return unpivot_measures(weather, ["Year", "Month", "Day", "Hour"], measures)
