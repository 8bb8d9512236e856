from datetime import datetime

from pyspark.sql import functions as F

from slotcast import fixed
from slotcast.functions import calendar as cal
from slotcast.functions import stamps
from slotcast.functions.direction import circular_mean, direction_class


def one_column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.orderBy("i").collect()]


def test_offset_stamps(spark):
    df = one_column(spark, ["2015-09-13T00:59:59+02:00", "2015-09-13T00:59:59", "2015-09-13T00:59:59-05:30", "no", None])
    out = df.select(
        "i",
        stamps.round_to_hour(stamps.parse_offset_stamp(F.col("x"))).alias("wall"),
        stamps.offset_text(F.col("x")).alias("offset"),
        stamps.parse_offset_stamp(F.col("x"), align="utc").alias("utc"),
    )
    assert values(out, "wall", "offset", "utc") == [
        (datetime(2015, 9, 13, 1), "+02:00", datetime(2015, 9, 12, 22, 59, 59)),
        (datetime(2015, 9, 13, 1), None, datetime(2015, 9, 13, 0, 59, 59)),
        (datetime(2015, 9, 13, 1), None, datetime(2015, 9, 13, 6, 29, 59)),
        (None, None, None),
        (None, None, None),
    ]


def test_day_first_stamps(spark):
    df = one_column(spark, ["13/09/16 03h00", "1/9/16 3h00", "32/13/16 00h00", "01/01/69 00h00", "01/01/68 00h00", None])
    out = df.select("i", stamps.parse_day_first_stamp(F.col("x")).alias("t"))
    assert values(out, "t") == [
        datetime(2016, 9, 13, 3), datetime(2016, 9, 1, 3), None, datetime(1969, 1, 1), datetime(2068, 1, 1), None]


def test_rounding_half_past_goes_up(spark):
    df = one_column(spark, ["2020-01-01 10:29:59", "2020-01-01 10:30:00", "2020-12-31 23:45:00"])
    out = df.select("i", stamps.round_to_hour(F.col("x").cast("timestamp")).alias("t"))
    assert values(out, "t") == [datetime(2020, 1, 1, 10), datetime(2020, 1, 1, 11), datetime(2021, 1, 1)]


def test_direction_classes(spark):
    df = one_column(spark, [0.0, 44.9, 45.0, 134.9, 135.0, 225.0, 314.9, 315.0, 360.0, -1.0, None], "double")
    out = df.select("i", direction_class(F.col("x")).alias("c"))
    assert values(out, "c") == [
        "North", "North", "East", "East", "South", "West", "West", "North", "North", None, None]


def test_circular_mean(spark):
    df = spark.createDataFrame([("a", 350.0), ("a", 10.0), ("b", 90.0), ("b", None), ("c", None)], "g string, x double")
    out = {r["g"]: r["m"] for r in df.groupBy("g").agg(circular_mean(F.col("x")).alias("m")).collect()}
    assert out == {"a": 0.0, "b": 90.0, "c": None}


def test_calendar_and_flags(spark):
    df = one_column(spark, [
        "2015-04-15 20:00:00", "2015-04-15 21:00:00", "2015-11-16 17:00:00", "2015-11-16 18:00:00",
        "2015-07-14 02:00:00", "2015-08-15 03:00:00"]).withColumn("datetime", F.col("x").cast("timestamp"))
    out = cal.with_flags(cal.with_calendar(df))
    assert values(out, "f_evening") == [0, 1, 0, 1, 0, 0]
    assert values(out, "f_season") == ["summer", "summer", "winter", "winter", "summer", "summer"]
    assert values(out, "f_ferie") == [0, 0, 0, 0, 0, 1]
    assert values(cal.with_flags(df, holiday_mode="any"), "f_ferie") == [0, 0, 0, 0, 1, 1]
    assert values(out, "f_midnight") == [0, 0, 0, 0, 1, 0]
    assert values(out, "f_hour") == [None, "H21", None, "H18", None, "H3"]
    assert values(out, "Weekday")[4:] == ["Tuesday", "Saturday"]
    assert values(out, "Month", "Day", "Year", "Hour")[5] == ("August", 15, 2015, 3)
    short = cal.with_calendar(df, abbreviated=True)
    assert values(short, "Weekday", "Month")[4] == ("Tue", "Jul")


def test_level_rank(spark):
    df = one_column(spark, ["Sunday", "Saturday", "Someday", None])
    assert values(df.select("i", cal.level_rank(F.col("x"), fixed.WEEKDAYS).alias("r")), "r") == [1, 7, None, None]
