import math

import pytest
from pyspark.sql import functions as F

from slotcast import fixed
from slotcast.operators import metrics
from slotcast.plans import evaluate
from slotcast.plans.features import SCENARIOS, prepare, prepare_many, project, training_table, union_of, weather_features
from slotcast.plans.models import Boosting, Forest, TargetModels, as_doubles, fit_targets, formula
from slotcast.session import materialise

TINY = Boosting(rounds=3, step=0.3, min_rows=2, depth=3)


def pairs(spark, rows):
    return spark.createDataFrame([(float(p), None if t is None else float(t)) for p, t in rows], "puissance double, reality double")


def test_error_measures(spark):
    row = metrics.error_metrics(pairs(spark, [(1, 2), (6, 4), (5, 5)])).first()
    assert row["rmse"] == pytest.approx(math.sqrt(5 / 3))
    assert row["mape"] == pytest.approx((0.5 + 0.5 + 0) / 3)
    assert row["mae"] == pytest.approx(1.0) and row["n"] == 3 and row["zero_truths"] == 0


def test_missing_pairs(spark):
    df = pairs(spark, [(1, 2), (6, None)])
    strict = metrics.error_metrics(df).first()
    assert strict["rmse"] is None and strict["mape"] is None and strict["mae"] is None
    lenient = metrics.error_metrics(df, strict=False).first()
    assert (lenient["rmse"], lenient["mape"], lenient["mae"]) == (1.0, 0.5, 1.0)


def test_zero_truth_is_counted(spark):
    df = pairs(spark, [(1, 0), (3, 2)])
    row = metrics.error_metrics(df).first()
    assert (row["mape"], row["zero_truths"], row["mae"]) == (0.5, 1, 1.0)
    assert [r["mape"] for r in metrics.with_row_error(df).orderBy("reality").collect()] == [None, 50.0]


def test_leaderboard_and_best(spark):
    rows = [("a", 9.0), ("a", 11.0), ("b", 8.0), ("b", 8.5), ("c", 30.0)]
    df = spark.createDataFrame(rows, "scenario string, mape double")
    board = metrics.leaderboard(df).orderBy("place").collect()
    assert [r["scenario"] for r in board] == ["b", "a", "c"]
    assert (board[1]["median"], board[1]["q1"], board[1]["repeats"]) == (10.0, 9.5, 2)
    assert tuple(metrics.best(df).first()) == ("b", 8.25)


def test_fixed_parameters_match_the_scenarios():
    assert Boosting.of("scale_group", 7) == Boosting(300, 0.01, 5, 1.0, 15)
    assert {number for _, number in fixed.BOOSTING} <= set(SCENARIOS)
    assert Forest().estimator("P0").getFeatureSubsetStrategy() == "onethird"


@pytest.fixture(scope="module")
def tables(spark):
    """Two weeks of an invented hourly load and slot covariates with gaps."""
    hours = spark.range(24 * 14).select(
        F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2015-10-20 00:00:00").cast("timestamp")).alias("datetime"),
        (500 + 100 * F.sin(F.col("id") / 24 * 2 * math.pi) + F.pmod(F.col("id") * 7, F.lit(13))).alias("puissance"))
    slots = hours.filter(F.hour("datetime") % 3 == 0)
    measures = {c: (F.rand(i) * 20).cast("double") for i, c in enumerate(fixed.WEATHER_COLUMNS[1:])}
    weather = slots.select("datetime").withColumns(measures).withColumns({
        "vt_dir": F.rand(99) * 360,
        "nebul": F.when(F.rand(7) > 0.2, F.col("nebul")),
        "rr_3h": F.lit(None).cast("double"),
    })
    weather = materialise(weather_features(weather))
    train = materialise(training_table(hours.filter(F.hour("datetime") != 5), weather, ["P0"], keep_levels=True))
    return train, weather


def test_training_table_keeps_slots_with_a_missing_hour(tables):
    train, _ = tables
    gaps = train.filter("DP2 IS NULL")
    assert gaps.count() == 14 and gaps.filter("P0 IS NULL").count() == 0


@pytest.mark.parametrize("number, width", [(1, 30), (2, 29), (3, 22), (4, 31), (5, 32), (6, 35), (7, 35)])
def test_scenario_widths(tables, number, width):
    train, weather = tables
    if number in (1, 7):
        _, _, columns = prepare(project(train, SCENARIOS[number]), project(weather, SCENARIOS[number]), SCENARIOS[number])
        assert len(columns) == width == len(set(columns))
    scenario = SCENARIOS[number]
    levels = sum(len(fixed.LEVELS[f]) for f in scenario.factors)
    assert levels + len(scenario.numerics) + len(scenario.others) == width


def test_scenario_with_flag_and_hour_as_factors(tables):
    train, weather = tables
    ready, asked, columns = prepare(project(train, SCENARIOS[8]), project(weather, SCENARIOS[8]), SCENARIOS[8])
    assert len(columns) == 34
    sums = ready.select(F.expr(" + ".join(f"`{c}`" for c in columns if c.startswith("Hour_"))).alias("s")).distinct().collect()
    assert [r["s"] for r in sums] == [1]
    assert set(columns) <= set(asked.columns)


def test_preparing_many_sets_equals_preparing_each(tables):
    train, weather = tables
    sets = {2: SCENARIOS[2], 6: SCENARIOS[6]}
    every = union_of(list(sets.values()))
    both, _, columns = prepare_many(project(train, every), project(weather, every), sets)
    for number, features in sets.items():
        alone, _, expected = prepare(project(train, features), project(weather, features), features)
        assert columns[number] == expected
        wanted = ["datetime", *expected]
        one, other = (sorted(map(tuple, df.select(*wanted).collect())) for df in (alone, both))
        for a, b in zip(one, other, strict=True):
            assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], nan_ok=True, abs=1e-9)


@pytest.mark.parametrize("preparation", ["impute_global_scale_global", "impute_group", "impute_group_scale_global"])
def test_preparations_run(tables, preparation):
    train, weather = tables
    ready, _, columns = prepare(project(train, SCENARIOS[1]), project(weather, SCENARIOS[1]), SCENARIOS[1], preparation)
    assert ready.filter("nebul IS NULL").count() == 0 and len(columns) == 30


def test_models_learn_skip_unlabelled_rows_and_reload(spark, tables, tmp_path):
    train, _ = tables
    columns = ["Hour", "f_weekend"]
    ready = as_doubles(train, columns)
    models = fit_targets(ready, columns, fixed.TARGETS, TINY)
    out = models.predict(ready.drop("P1", "P2", "DP12"))
    assert out.filter("P0 IS NULL OR DP2 IS NULL").count() == 0
    real = train.select("datetime", F.col("P0").alias("reality"))
    error = metrics.error_metrics(out.select("datetime", F.col("P0").alias("puissance")).join(real, "datetime")).first()
    assert error["mape"] < 0.1
    models.save(spark, str(tmp_path / "models"))
    again = TargetModels.load(spark, str(tmp_path / "models"), fixed.TARGETS, columns).predict(ready)
    first, second = (sorted((r["datetime"], r["P0"], r["DP1"], r["DP2"]) for r in df.collect()) for df in (out, again))
    assert first == second


def test_forest_takes_text_factors(tables):
    train, weather = tables
    models = fit_targets(as_doubles(train, ["Hour"]), ["Hour", "Weekday"], ["P0"], Forest(trees=3, depth=4), categories=["Weekday"])
    assert models.predict(as_doubles(weather, ["Hour"])).filter("P0 IS NULL").count() == 0


def test_formula_builds_the_matrix(tables):
    train, _ = tables
    out = formula("P0", ["temp", "Weekday"]).fit(train).transform(train)
    assert out.first()["features"].size == 8  # one more for levels that training has not


def test_holdout_and_forecast(tables):
    train, weather = tables
    results = evaluate.repeated_holdout(train, SCENARIOS[2], TINY, [1, 2]).orderBy("repeat").collect()
    assert [r["repeat"] for r in results] == [1, 2]
    held_out = train.count() - math.floor(0.79 * train.count())
    assert all(r["n"] == 3 * held_out and 0 < r["mape"] < 60 for r in results)
    hourly, _ = evaluate.forecast(train, weather.filter("datetime >= '2015-10-30'"), 2, TINY)
    assert hourly.count() == 3 * weather.filter("datetime >= '2015-10-30'").count()
    assert hourly.filter("temp IS NOT NULL").count() == hourly.count() // 3
    chained, _ = evaluate.forecast(train, weather.filter("datetime >= '2015-11-01'"), 3, TINY, chained=True)
    assert chained.filter("puissance IS NULL").count() == 0


def test_sweep_agrees_with_single_scenarios(tables):
    train, _ = tables
    swept = {r["scenario"]: r for r in evaluate.scenario_sweep(train, TINY, [3], {2: SCENARIOS[2], 8: SCENARIOS[8]}).collect()}
    alone = evaluate.repeated_holdout(train, SCENARIOS[2], TINY, [3], "scenario 2").first()
    assert set(swept) == {"scenario 2", "scenario 8"}
    assert swept["scenario 2"]["mape"] == pytest.approx(alone["mape"], rel=1e-6)


def test_forecast_sweep_writes_each_run(spark, tables, tmp_path):
    train, weather = tables
    ahead = weather.filter("datetime >= '2015-10-31'")
    reality = train.select("datetime", F.col("P0").alias("reality"))
    errors = evaluate.forecast_sweep(train, ahead, reality, TINY, {2: SCENARIOS[2], 7: SCENARIOS[7]}, base=str(tmp_path / "runs"), strict=False).collect()
    assert [r["scenario"] for r in errors] == ["scenario 2", "scenario 7"] and all(r["mape"] > 0 for r in errors)
    written = spark.read.option("header", True).option("sep", ";").option("mergeSchema", True).csv(str(tmp_path / "runs"))
    assert {r["run"].split("_")[2] for r in written.select("run").distinct().collect()} == {"forecast2", "forecast7"}
    assert written.count() == 2 * 3 * ahead.count()
