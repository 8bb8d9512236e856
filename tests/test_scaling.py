import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from slotcast.operators.encode import OneHot
from slotcast.operators.scaling import GroupImputeGlobalScale, Standardiser


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, g string, x double")


def by_id(df, column="x"):
    return {r["id"]: r[column] for r in df.collect()}


def test_deviation_is_taken_after_imputation(spark):
    df = frame(spark, [(1, "a", 1.0), (2, "a", 2.0), (3, "a", None), (4, "a", 5.0)])
    model = Standardiser(["x"], ["g"]).fit(df)
    stats = model.stats.first()
    assert stats["x__mean"] == pytest.approx(8 / 3)
    assert stats["x__sd"] == pytest.approx(1.6996731711975948)
    unfilled = Standardiser(["x"], ["g"], na_replace=False).fit(df)
    assert unfilled.stats.first()["x__sd"] == pytest.approx(2.0816659994661326)
    out = by_id(model.transform(df))
    assert out[3] == 0.0
    assert by_id(unfilled.transform(df))[3] is None


def test_edge_groups(spark):
    train = frame(spark, [(1, "one", 3.0), (2, "flat", 4.0), (3, "flat", 4.0), (4, "flat", 4.0),
                          (5, None, 1.0), (6, None, 3.0), (7, "void", None), (8, "void", None)])
    test = frame(spark, [(9, "new", 7.0), (10, "new", None), (11, None, None), (12, "one", 5.0), (13, "void", 2.0)])
    model = Standardiser(["x"], ["g"]).fit(train)
    out = by_id(model.transform(train)) | by_id(model.transform(test))
    assert out[1] == 0.0
    assert (out[2], out[3], out[4]) == (0.0, 0.0, 0.0)
    root = math.sqrt(2)
    assert out[5] == pytest.approx(-1 / root) and out[6] == pytest.approx(1 / root)
    assert out[7] is None and out[8] is None
    assert (out[9], out[10], out[11], out[12], out[13]) == (7.0, None, 0.0, 2.0, 2.0)


def test_groups_end_up_with_mean_zero_and_deviation_one(spark):
    random.seed(3)
    rows = [(i, random.choice("abc"), random.choice([None, random.gauss(50, 9)])) for i in range(400)]
    df = frame(spark, rows)
    scaled = Standardiser(["x"], ["g"]).fit(df).transform(df)
    for r in scaled.groupBy("g").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.count("x").alias("n"),
                                     F.count(F.lit(1)).alias("all")).collect():
        assert r["m"] == pytest.approx(0, abs=1e-12) and r["s"] == pytest.approx(1)
        assert r["n"] == r["all"]


def test_group_impute_global_scale_matches_two_steps(spark):
    random.seed(5)
    rows = [(i, random.choice(["a", "b", None]), random.choice([None, random.gauss(1e6, 3)])) for i in range(300)]
    rows.append((300, "void", None))
    df = frame(spark, rows)
    step1 = Standardiser(["x"], ["g"], center=False, scale=False).fit(df).transform(df)
    step2 = Standardiser(["x"], na_replace=False).fit(step1).transform(step1)
    once = GroupImputeGlobalScale(["x"], ["g"]).fit(df).transform(df)
    expected, got = by_id(step2), by_id(once)
    assert expected[300] is None and got[300] is None
    for i in range(300):
        assert got[i] == pytest.approx(expected[i], abs=1e-6)
    assert statistics.fmean(v for v in got.values() if v is not None) == pytest.approx(0, abs=1e-6)


def test_groups_without_values_can_take_the_overall_mean(spark):
    train = frame(spark, [(1, "a", 1.0), (2, "a", None), (3, "b", 7.0), (4, "void", None)])
    model = GroupImputeGlobalScale(["x"], ["g"], rescale=False).fit(train)
    assert by_id(model.transform(train)) == {1: 1.0, 2: 1.0, 3: 7.0, 4: 3.0}
    assert by_id(model.transform(frame(spark, [(5, "new", None), (6, "new", 2.0)]))) == {5: 3.0, 6: 2.0}


def test_global_scaler_is_a_projection(spark, plan):
    df = frame(spark, [(1, "a", 1.0), (2, "b", 3.0), (3, "b", None)])
    out = Standardiser(["g", "x"]).fit(df).transform(df)
    assert out.columns == ["id", "g", "x"]
    assert "Join" not in plan(out) and "Exchange" not in plan(out)
    assert by_id(out) == pytest.approx({1: -1.0, 2: 1.0, 3: 0.0})


def test_group_scaler_broadcasts_its_statistics(spark, plan):
    df = frame(spark, [(1, "a", 1.0), (2, "b", 3.0)])
    text = plan(Standardiser(["x"], ["g"]).fit(df).transform(df))
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text


def test_large_statistics_are_joined_without_broadcast(spark, plan, monkeypatch):
    """Beyond the row limit there is no hint; the threshold stands for a table too large for Spark's own choice."""
    monkeypatch.setattr("slotcast.operators.sizing.BROADCAST_ROWS", 1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = frame(spark, [(1, "a", 1.0), (2, "a", 3.0), (3, None, 5.0), (4, "c", None)])
        out = Standardiser(["x"], ["g"]).fit(df).transform(df)
        assert "SortMergeJoin" in plan(out) and "Broadcast" not in plan(out)
        assert by_id(out)[3] == 0.0 and by_id(out)[4] is None
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_non_numeric_columns_are_left_alone(spark):
    df = frame(spark, [(1, "a", 1.0)])
    model = Standardiser(["g"]).fit(df)
    assert model.columns == [] and by_id(model.transform(df)) == {1: 1.0}


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "North", "y"), (2, None, "n"), (3, "East", None)], "id int, rose_vt string, flag string")
    model = OneHot(["rose_vt", "flag"]).fit(df)
    assert model.columns == ["North", "East", "South", "West", "flag_n", "flag_y"]
    out = {r["id"]: tuple(r)[1:] for r in model.transform(df).collect()}
    assert out == {1: (1, 0, 0, 0, 0, 1), 2: (0, 0, 0, 0, 1, 0), 3: (0, 1, 0, 0, 0, 0)}
    kept = OneHot(["rose_vt"], remove=False).fit(df).transform(df)
    assert kept.columns[:3] == ["id", "rose_vt", "flag"]


def test_levels_come_from_train_only(spark):
    train = spark.createDataFrame([(3,), (12,), (3,), (None,)], "h int")
    test = spark.createDataFrame([(12,), (21,)], "h int")
    model = OneHot(["h"]).fit(train)
    assert model.columns == ["h_3", "h_12"]
    assert sorted(map(tuple, model.transform(test).collect())) == [(0, 0), (0, 1)]


def test_clashing_levels_get_a_prefix(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "c")], "u string, v string")
    assert OneHot(["u", "v"]).fit(df).columns == ["u_a", "b", "v_a", "c"]
    assert OneHot(["u", "v"], prefix="always").fit(df).columns == ["u_a", "u_b", "v_a", "v_c"]


def test_quotes_in_levels_and_names(spark):
    df = spark.createDataFrame([("it's", 1.0), ("a\\b", 3.0)], "`odd name` string, `x y` double")
    out = OneHot(["odd name"]).fit(df).transform(Standardiser(["x y"]).fit(df).transform(df))
    assert out.columns == ["x y", "a\\b", "it's"]
    assert sorted(map(tuple, out.collect()))[0][1:] == (0, 1)
