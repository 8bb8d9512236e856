import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotcast.operators import profile, quantiles
from slotcast.operators.split import exact_split, exact_splits

PROBS = [0.25, 0.5, 0.75]


def expected(rows, column):
    values = np.array([r[column] for r in rows if r[column] is not None])
    return [float(np.quantile(values, p)) for p in PROBS]


def skewed(spark, n):
    """A third of the rows hold one value, some are far out, some are NULL."""
    random.seed(n)
    rows = []
    for i in range(n):
        kind = random.random()
        x = 5.0 if kind < 0.33 else None if kind < 0.4 else random.gauss(0, 1) * 10 ** random.randint(0, 12)
        rows.append(("hot" if random.random() < 0.9 else random.choice(["cold", None]), x, float(i % 7)))
    return rows, spark.createDataFrame(rows, "g string, x double, y double").repartition(4)


def test_quantiles_match_brute_force(spark):
    rows, df = skewed(spark, 6000)
    out = quantiles.exact_quantiles(df, ["x", "y"], PROBS, ["g"]).collect()
    assert len(out) == 6
    for r in out:
        at = {"x": 1, "y": 2}[r["variable"]]
        group = [row for row in rows if row[0] == r["g"]]
        assert [r["q0"], r["q1"], r["q2"]] == pytest.approx(expected(group, at), rel=1e-12)
        assert r["n"] == sum(row[at] is not None for row in group)


def test_a_bad_sketch_costs_time_but_not_the_result(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "ACCURACY", 3)
    monkeypatch.setattr(quantiles, "MARGIN", 0.0)
    rows, df = skewed(spark, 3000)
    out = quantiles.exact_quantiles(df, ["x"], PROBS).first()
    assert [out["q0"], out["q1"], out["q2"]] == pytest.approx(expected(rows, 1), rel=1e-12)


def test_no_window_partition_holds_a_large_share(spark, monkeypatch):
    """With a useless first sketch the missed regions are cut into even bins."""
    monkeypatch.setattr(quantiles, "MARGIN", 0.0)
    real, first = F.expr, []

    def coarse(text):
        if "percentile_approx(double" in text and not first:
            first.append(text)
            text = text.replace(f", {quantiles.ACCURACY})", ", 1)")
        return real(text)

    monkeypatch.setattr(quantiles.F, "expr", coarse)
    seen = []
    write = quantiles.materialise
    monkeypatch.setattr(quantiles, "materialise", lambda df: seen.append(write(df)) or seen[-1])
    df = spark.range(40_000).select((F.pmod(F.col("id") * 7919, F.lit(40_000)) ** 2).cast("double").alias("x"))
    out = quantiles.exact_quantiles(df, ["x"], PROBS).first()
    assert [out["q0"], out["q1"], out["q2"]] == pytest.approx([float(np.quantile(np.arange(40_000.0) ** 2, p)) for p in PROBS], rel=1e-12)
    tables = [t for t in seen if "value" in t.columns and "bin" in t.columns]
    assert len(tables) == 2
    largest = tables[-1].where("value is not null").groupBy("region", "bin").count().agg(F.max("count")).first()[0]
    assert largest <= 2000


def test_tiny_groups(spark):
    df = spark.createDataFrame([("a", 4.0), ("b", 1.0), ("b", 2.0), ("c", None)], "g string, x double")
    out = {r["g"]: (r["q0"], r["q1"], r["q2"]) for r in quantiles.exact_quantiles(df, ["x"], PROBS, ["g"]).collect()}
    assert out == {"a": (4.0, 4.0, 4.0), "b": (1.25, 1.5, 1.75)}


def test_summary_and_boxes(spark):
    df = spark.createDataFrame([(float(v), None) for v in (1, 2, 3, 4, 5, 6, 7)] + [(50.0, 2.0), (None, 2.0)], "x double, y double")
    x, y = profile.table_summary(df, ["x", "y"]).orderBy("variable").collect()
    assert (x["min"], x["q1"], x["median"], x["q3"], x["max"], x["nulls"]) == (1.0, 2.75, 4.5, 6.25, 50.0, 1)
    assert (y["min"], y["median"], y["nulls"]) == (2.0, 2.0, 7)
    box = profile.box_numbers(df, ["x"]).first()
    assert (box["whisker_low"], box["whisker_high"], box["outliers"]) == (1.0, 7.0, 1)
    means = {r["variable"]: r["mean"] for r in profile.moments(df, ["x", "y"]).collect()}
    assert means == {"x": 9.75, "y": 2.0}


def test_null_profile(spark):
    df = spark.createDataFrame([(1, None, None), (2, "u", None), (3, "v", 1.0), (4, "w", None)], "a int, b string, c double")
    out = profile.null_profile(df).orderBy("place").collect()
    assert [(r["variable"], r["nb_na"], r["p_na"]) for r in out] == [("c", 3, 0.75), ("b", 1, 0.25)]
    names = profile.null_profile(df, simplify=False, pareto=False).orderBy("place").collect()
    assert [r["variable"] for r in names] == ["a", "b", "c"]


def test_crosstab_has_null_for_empty_cells(spark):
    df = spark.createDataFrame([("Sunday", "May", 1.0), ("Sunday", "May", 3.0), ("Monday", "June", 2.0)], "w string, m string, v double")
    out = {r["w"]: r for r in profile.crosstab(df, "w", "m", ["May", "June"], "v").collect()}
    assert out["Sunday"]["May_mean"] == 2.0 and out["Sunday"]["June_mean"] is None
    assert out["Monday"]["June_sd"] is None


@pytest.mark.parametrize("rounding, train", [("round", 8), ("floor", 7)])
def test_split_sizes(spark, rounding, train):
    split = exact_split(spark.range(10), "id", 0.79, seed=4, rounding=rounding)
    left, right = split.train.collect(), split.test.collect()
    assert (len(left), len(right)) == (train, 10 - train)
    assert sorted(r["id"] for r in left + right) == list(range(10))


def test_splits_are_exact_disjoint_and_seeded(spark):
    df = spark.range(5000).withColumn("k", F.concat(F.lit("row "), F.col("id")))
    splits = exact_splits(df, "k", [1, 2], 0.75)
    sides = {s: {r["id"] for r in split.train.collect()} for s, split in splits.items()}
    for s, split in splits.items():
        assert len(sides[s]) == 3750 and split.test.count() == 1250
        assert not sides[s] & {r["id"] for r in split.test.collect()}
    assert 0.5 < len(sides[1] & sides[2]) / 3750 < 0.95
    assert {r["id"] for r in exact_split(df.repartition(7), "k", 0.75, seed=1).train.collect()} == sides[1]


def test_split_ties_are_broken_by_key(spark, monkeypatch):
    monkeypatch.setattr("slotcast.operators.split.split_hash", lambda key, seed: F.lit(77).cast("bigint"))
    split = exact_split(spark.range(100), "id", 0.3)
    assert sorted(r["id"] for r in split.train.collect()) == list(range(30))
    copies = spark.range(10).withColumn("id", F.lit(1))
    with pytest.raises(ValueError, match="unique"):
        exact_split(copies, "id", 0.3)


def test_split_extremes(spark):
    df = spark.range(4)
    assert exact_split(df, "id", 0.0).train.count() == 0
    assert exact_split(df, "id", 1.0).test.count() == 0
    assert exact_split(df.limit(0), "id", 0.5).train.count() == 0


def test_split_sides_are_plain_filters(spark, plan):
    split = exact_split(spark.range(1000), "id", 0.5)
    for side in (split.train, split.test):
        assert "Exchange" not in plan(side) and "Join" not in plan(side)


def plain_box(values, reach=1.5):
    v = np.sort(np.array([x for x in values if x is not None], dtype=float))
    q1, median, q3 = np.quantile(v, [0.25, 0.5, 0.75])
    low, high = q1 - reach * (q3 - q1), q3 + reach * (q3 - q1)
    inside = v[(v >= low) & (v <= high)]
    return (inside.min(), q1, median, q3, inside.max(), int(len(v) - len(inside)))


def test_boxes_from_two_passes_equal_plain_numbers(spark):
    """Fences far out, inside the box, among ties and in groups of any size; no third pass is needed for any of them."""
    rng = np.random.default_rng(8)
    made = {
        "normal": rng.normal(size=4000), "heavy": rng.standard_t(1.2, size=5000), "ties": rng.integers(0, 4, 3000).astype(float), "one": np.array([3.0]),
        "constant": np.append(np.full(500, 2.0), [1.0, 9.0]), "two": np.array([1.0, 100.0]), "few": np.append(rng.normal(size=9), [50.0, -70.0]), "skewed": rng.lognormal(0, 3, 20_000),
    }
    rows = [(g, float(x), None if i % 3 else float(-x)) for g, v in made.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    got = {(r["g"], r["variable"]): r for r in quantiles.box_counts(df, ["x", "y"], by=["g"]).collect()}
    for g, v in made.items():
        for variable, values in (("x", v), ("y", [-x for i, x in enumerate(v) if i % 3 == 0])):
            r = got[g, variable]
            want = plain_box(values)
            assert np.allclose([r["whisker_low"], r["q1"], r["median"], r["q3"], r["whisker_high"]], want[:5], rtol=1e-9, atol=1e-12), (g, variable)
            assert r["outliers"] == want[5]


def test_a_box_that_is_torn_is_counted_again(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "MARGIN", 0.0)
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(float(x),) for x in rng.standard_t(2, size=3001)], "x double")
    box = profile.box_numbers(df, ["x"]).first()
    want = plain_box([r["x"] for r in df.collect()])
    assert np.allclose([box["whisker_low"], box["q1"], box["median"], box["q3"], box["whisker_high"]], want[:5]) and box["outliers"] == want[5]
