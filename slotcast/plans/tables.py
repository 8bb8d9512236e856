"""Input tables of the registered queries, derived from the given Parquet files.

Events play the measured series: their mean value per hour is the load, and their values by
type and slot are the covariates. Sums run over whole cents, so means do not depend on the
order in which partitions are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotcast.fixed import SLOT_HOURS
from slotcast.functions.stamps import slot_start

# the last eight days of the events are the forecast horizon
FORECAST_START = "2024-01-23 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def _mean(amount: Column, where: Column) -> Column:
    known = F.nullif(F.count(F.when(where, 1)), F.lit(0).cast("bigint"))
    return F.sum(F.when(where, cents(amount))).cast("double") / F.lit(100.0) / known


def hourly_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp").alias("datetime")
    return events.groupBy(hour).agg(_mean(F.col("value"), F.lit(True)).alias("puissance"))


def slot_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kind, value = F.col("event_type"), F.col("value")
    slot = slot_start(F.col("ts").cast("timestamp"), SLOT_HOURS).alias("datetime")
    return events.groupBy(slot).agg(
        _mean(value, kind == "view").alias("temp"),
        _mean(value, kind == "click").alias("pression"),
        _mean(value, kind == "signup").alias("hr"),
        _mean(value, kind == "purchase").alias("p_rosee"),
        _mean(value, kind == "error").alias("visi"),
        _mean(value, F.lit(True)).alias("vt_moy"),
        F.max(value).alias("vt_raf"),
        F.pmod(F.min("event_id") * 37, F.lit(361)).cast("double").alias("vt_dir"),
        F.max(F.when((kind == "purchase") & (value >= 100), value)).alias("rr_3h"),
        F.max(F.when((kind == "error") & (value >= 200), value)).alias("neige"),
        F.nullif(F.count_if((kind == "error") & (value >= 100)), F.lit(0).cast("bigint")).cast("double").alias("nebul"),
    )


def ahead(df: DataFrame, time: str = "datetime") -> Column:
    return F.col(time) >= F.lit(FORECAST_START).cast(df.schema[time].dataType)


def measures_with_gaps(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    """Line items with a discount or tax of zero read as not recorded."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        *keys, "l_quantity", "l_extendedprice",
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("l_discount"),
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("l_tax"),
    )
