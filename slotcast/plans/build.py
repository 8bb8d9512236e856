"""From delimited input files to the stored training and forecast tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotcast import fixed
from slotcast.functions.stamps import offset_text, parse_day_first_stamp, parse_offset_stamp, round_to_hour
from slotcast.operators.clean import drop_duplicate_rows, until
from slotcast.plans.features import training_table, weather_features
from slotcast.sources.delimited import read_delimited
from slotcast.sources.snapshots import load_tables, save_tables

CLEANED = ["conso_train", "meteo_train", "meteo_prev"]
READY = ["data_train", "data_prev"]


def _schema(names: list[str]) -> T.StructType:
    """Stamps as text, everything else as numbers."""
    return T.StructType([T.StructField(n, T.StringType() if n == "datetime" else T.DoubleType()) for n in names])


def read_load(spark: SparkSession, path: str, align: str = "wall") -> DataFrame:
    """The hourly series: copies of a line dropped, stamps at full hours, offset in ``fuseau``."""
    rows = drop_duplicate_rows(read_delimited(spark, path, _schema(fixed.LOAD_COLUMNS)))
    text = F.col("datetime")
    return rows.select(
        round_to_hour(parse_offset_stamp(text, align)).alias("datetime"), "puissance", offset_text(text).alias("fuseau"))


def read_weather(spark: SparkSession, path: str, dedup: bool = True) -> DataFrame:
    """The slot covariates with calendar, flag and direction columns."""
    rows = read_delimited(spark, path, _schema(fixed.WEATHER_COLUMNS))
    rows = drop_duplicate_rows(rows) if dedup else rows
    return weather_features(rows.withColumn("datetime", parse_day_first_stamp(F.col("datetime"))))


def build_tables(spark: SparkSession, load_path: str, weather_path: str, ahead_path: str, folder: str,
                 forecast_end: str = fixed.FORECAST_END, align: str = "wall",
                 on_duplicate: str = "error") -> dict[str, DataFrame]:
    """Clean the three inputs, store them, build and store the tables for models."""
    save_tables({
        "conso_train": read_load(spark, load_path, align),
        "meteo_train": read_weather(spark, weather_path),
        "meteo_prev": read_weather(spark, ahead_path, dedup=False),
    }, folder)
    cleaned = load_tables(spark, folder, CLEANED)
    load = cleaned["conso_train"].select("datetime", "puissance")
    save_tables({
        "data_train": training_table(load, cleaned["meteo_train"], ["P0", "DP1", "DP2", "DP12"], on_duplicate=on_duplicate),
        "data_prev": until(cleaned["meteo_prev"], forecast_end),
    }, folder)
    return cleaned | load_tables(spark, folder, READY)
