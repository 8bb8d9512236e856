from datetime import datetime

import pytest
from pyspark.sql import functions as F

from slotcast.operators import clean, combine, fold, position


def series(spark, hours, start="2016-03-27 00:00:00"):
    rows = [(h, float(v)) for h, v in hours]
    df = spark.createDataFrame(rows, "h int, puissance double")
    return df.select(F.timestamp_add("HOUR", F.col("h"), F.lit(start).cast("timestamp")).alias("datetime"), "puissance")


def test_gap_leaves_null_targets(spark):
    slots = fold.fold_hourly(series(spark, [(0, 10), (1, 12), (3, 1), (4, 2), (5, 4)])).orderBy("datetime").collect()
    assert [tuple(r)[1:] for r in slots] == [(10.0, 2.0, None, None), (1.0, 1.0, 3.0, 2.0)]
    assert slots[1]["datetime"] == datetime(2016, 3, 27, 3)


def test_duplicate_hours(spark):
    twice = series(spark, [(0, 1), (1, 2), (1, 4), (2, 5)])
    with pytest.raises(Exception, match="more than once"):
        fold.fold_hourly(twice).collect()
    mean = fold.fold_hourly(twice, on_duplicate="mean", keep_levels=True).first()
    assert (mean["P0"], mean["P1"], mean["P2"]) == (1.0, 3.0, 5.0)
    first = fold.fold_hourly(twice, on_duplicate="first", order="puissance", keep_levels=True).first()
    assert (first["P1"], first["DP1"]) == (2.0, 1.0)
    with pytest.raises(ValueError):
        fold.fold_hourly(twice, on_duplicate="first")


def test_unfold_inverts_fold(spark):
    hours = series(spark, [(h, (h * 7) % 11 + 0.5) for h in range(48)])
    slots = fold.fold_hourly(hours)
    for chained in (False, True):
        back = fold.unfold(fold.recompose(slots, chained))
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, hours.collect()))


def test_unfold_keeps_columns(spark):
    slots = fold.fold_hourly(series(spark, [(0, 1), (1, 2), (2, 3)]), keep_levels=True).withColumn("tag", F.lit("x"))
    assert sorted(r["tag"] for r in fold.unfold(slots, keep=["tag"]).collect()) == ["x", "x", "x"]


def test_fold_needs_one_shuffle(spark, plan):
    text = plan(fold.fold_hourly(series(spark, [(0, 1), (1, 2)])))
    assert text.count("Exchange hashpartitioning") == 1


def test_required_target_turns_outer_into_inner(spark):
    slots = fold.fold_hourly(series(spark, [(0, 1), (1, 2), (2, 3), (3, 9)]))
    weather = series(spark, [(0, 5), (3, 6), (6, 7)]).withColumnRenamed("puissance", "temp")
    joined = combine.join_covariates(slots, weather, required=["P0", "DP1"])
    assert "Join Inner" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert [r["temp"] for r in joined.collect()] == [5.0]
    assert combine.join_covariates(slots, weather).count() == 3


def test_join_back_keeps_every_hour(spark):
    hours = series(spark, [(h, h) for h in range(6)])
    weather = series(spark, [(0, 5), (3, 6)]).withColumnRenamed("puissance", "temp")
    out = combine.join_back(hours, weather).orderBy("datetime").collect()
    assert [r["temp"] for r in out] == [5.0, None, None, 6.0, None, None]


def test_dedup(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", None), ("b", None)], "k string, v int")
    assert sorted(clean.drop_duplicate_rows(rows).collect(), key=str) == sorted([("a", 1), ("b", 1), ("b", None)], key=str)
    assert tuple(clean.duplicate_counts(rows).first()) == (5, 3, 2)
    distinct = rows.distinct()
    assert clean.drop_duplicate_rows(distinct).count() == 3
    assert tuple(clean.duplicate_counts(rows.limit(0)).first()) == (0, 0, 0)


def test_time_bound_keeps_the_last_stamp(spark):
    hours = series(spark, [(h, h) for h in range(30)], start="2016-09-20 00:00:00")
    assert clean.until(hours, "2016-09-20 23:00:00").count() == 24


def test_rename_checks_the_count(spark):
    df = spark.range(1)
    assert clean.rename_by_position(df, ["x"]).columns == ["x"]
    with pytest.raises(ValueError):
        clean.rename_by_position(df, ["x", "y"])


def test_positions_follow_time(spark):
    hours = series(spark, [(h, h) for h in (50, 3, 27, 4, 0, 100)])
    out = position.with_position(hours, ties=[]).orderBy("datetime").collect()
    assert [r["position"] for r in out] == list(range(6))
    assert [r["puissance"] for r in out] == [0.0, 3.0, 4.0, 27.0, 50.0, 100.0]


def test_attach_by_position(spark):
    hours = series(spark, [(h, h) for h in range(5)])
    vector = spark.createDataFrame([(i, 100.0 + i) for i in range(5)], "position long, reality double")
    by_place = position.attach_by_position(position.with_position(hours, ties=[]), vector, "reality", after="datetime")
    assert by_place.columns == ["datetime", "reality", "puissance"]
    assert all(r["reality"] == 100.0 + r["puissance"] for r in by_place.collect())
    assert by_place.count() == 5


def test_tagged_union(spark):
    a, b = spark.range(2), spark.range(3)
    tags = [r["DATA_"] for r in combine.tagged_union(a, b).collect()]
    assert (tags.count("train"), tags.count("test")) == (2, 3)


def test_a_duplicate_hour_can_not_be_pruned_away(spark):
    hours = series(spark, [(0, 1), (1, 2), (1, 3), (2, 4)])
    for column in ("P0", "P1", "DP2"):
        with pytest.raises(Exception, match="more than once"):
            fold.fold_hourly(hours, keep_levels=True).select(column).collect()


def test_slots_divide_the_day(spark):
    with pytest.raises(ValueError):
        fold.fold_hourly(series(spark, [(0, 1)]), slot_hours=5)
