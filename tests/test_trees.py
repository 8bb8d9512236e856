import math
import random

import numpy as np
import pytest

from slotcast import fixed
from slotcast.operators.scaling import GroupImputeGlobalScale, Standardiser
from slotcast.operators.trees import TreeModel, bin_edges, binned, fit_models, fit_rows, weights
from slotcast.plans import evaluate, many
from slotcast.plans.features import PREPARATIONS, FeatureSet
from slotcast.plans.models import Boosting
from slotcast.session import materialise

SCHEMA = "key string, row bigint, train boolean, bins binary, y array<double>, extra array<double>"


def table(spark, keys=3, n=60, columns=5, seed=1, partitions=4):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(keys):
        for i in range(n):
            bins = [int(b) for b in rng.integers(0, 6, columns)]
            y = [float(bins[0] * 3 + bins[1] % 2 + rng.normal()), float(bins[2] - bins[3] * bins[0])]
            if rng.random() < 0.1:
                y[0] = rng.choice([None, math.nan])
            rows.append((f"k{k}", i * 7 + k, bool(rng.random() < 0.8), bytes(bins), y, [float(i)]))
    return materialise(spark.createDataFrame(rows, SCHEMA).repartition(partitions)), rows


def plain_boost(rows, model):
    """One model by trying every cut of every column in every node, with Python numbers."""
    used = [r for r in rows if r[2] and r[4][model.target] is not None and not math.isnan(r[4][model.target])]
    y = {r[1]: r[4][model.target] for r in used}
    f = {r[1]: sum(y.values()) / len(y) for r in rows}
    for k in range(model.rounds):
        w = dict(zip([r[1] for r in used], weights(model, k, np.array([r[1] for r in used])).tolist()))
        inside = [r for r in used if w[r[1]]]

        def leaf(group):
            return sum(y[r[1]] - f[r[1]] for r in group) / (len(group) + model.penalty)

        def grow(group, depth):
            total, best = sum(y[r[1]] - f[r[1]] for r in group), None
            if depth:
                for c in range(len(model.columns)):
                    for cut in sorted({r[3][model.columns[c]] for r in group})[:-1]:
                        left = [r for r in group if r[3][model.columns[c]] <= cut]
                        right = len(group) - len(left)
                        if min(len(left), right) < model.min_rows:
                            continue
                        s = sum(y[r[1]] - f[r[1]] for r in left)
                        gain = s * s / (len(left) + model.penalty) + (total - s) ** 2 / (right + model.penalty) - total**2 / (len(group) + model.penalty)
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-7):
                            best = (gain, model.columns[c], cut)
            if best is None:
                return leaf(group)
            _, c, cut = best
            return c, cut, grow([r for r in group if r[3][c] <= cut], depth - 1), grow([r for r in group if r[3][c] > cut], depth - 1)

        def value(node, bins):
            while isinstance(node, tuple):
                node = node[2] if bins[node[0]] <= node[1] else node[3]
            return node

        tree = grow(inside, model.depth)
        f = {r[1]: f[r[1]] + model.step * value(tree, r[3]) for r in rows}
    return f


def predictions(df, column="hat"):
    return {(r["key"], r["row"]): r[column] for r in df.collect()}


def test_boosting_equals_plain_search(spark):
    stored, rows = table(spark, keys=2, n=50)
    models = [TreeModel(0, (0, 1, 2, 3, 4), rounds=3, step=0.3, min_rows=3, depth=4), TreeModel(1, (0, 2, 3), rounds=2, step=0.5, min_rows=2, depth=3, subsample=0.7, penalty=0.0)]
    got = predictions(fit_models(stored, models))
    assert len(got) == len(rows)
    for key in ("k0", "k1"):
        mine = [r for r in rows if r[0] == key]
        for k, model in enumerate(models):
            want = plain_boost(mine, model)
            assert all(abs(got[key, i][k] - v) < 1e-6 for i, v in want.items())


def test_jobs_by_level_give_the_same_trees(spark, monkeypatch):
    """Large keys: rows stay where they are and sums meet; bit for bit the same predictions, stored half-way or not."""
    monkeypatch.setattr("slotcast.operators.trees.STORE_EVERY", 2)
    stored, _ = table(spark, keys=2, n=40, partitions=3)
    models = [
        TreeModel(0, (0, 1, 2, 3, 4), rounds=3, step=0.1, min_rows=2, depth=3, subsample=0.8), TreeModel(1, (1, 2, 3), rounds=2, step=1.0, min_rows=1, depth=4, penalty=0.0),
        TreeModel(1, (0, 1, 2, 3), rounds=3, min_rows=2, depth=3, penalty=0.0, bagging=True, columns_drawn=2),
    ]
    small, large = fit_models(stored, models), fit_models(stored, models, key_rows=10)
    for column in ("hat", "out"):
        a, b = predictions(small, column), predictions(large, column)
        assert a.keys() == b.keys() and all(np.array_equal(a[k], b[k], equal_nan=True) for k in a)
    assert sorted(map(str, small.select("key", "row", "train", "extra").collect())) == sorted(map(str, large.select("key", "row", "train", "extra").collect()))


def test_partitions_and_order_change_nothing(spark):
    models = [TreeModel(0, (0, 1, 2, 3, 4), rounds=5, step=0.1)]
    a, b = (predictions(fit_models(table(spark, partitions=p)[0], models)) for p in (1, 7))
    assert a == b


def test_a_tree_without_penalty_predicts_group_means():
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 8, (300, 1)).astype(np.uint8)
    y = rng.normal(size=300)
    train = rng.random(300) < 0.8
    hat, _ = fit_rows(bins, train, y, np.arange(300), TreeModel(0, (0,), rounds=1, step=1.0, min_rows=1, penalty=0.0))
    for b in range(8):
        assert np.allclose(hat[bins[:, 0] == b], y[train & (bins[:, 0] == b)].mean(), atol=1e-9)


def test_bags_are_poisson_and_out_of_bag_rows_unseen():
    model = TreeModel(0, (0, 1), rounds=40, depth=6, min_rows=1, penalty=0.0, bagging=True)
    w = np.stack([weights(model, t, np.arange(4000)) for t in range(5)])
    assert abs(w.mean() - 1) < 0.03 and abs((w == 0).mean() - math.exp(-1)) < 0.02 and not (w[0] == w[1]).all()
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 10, (200, 2)).astype(np.uint8)
    y = bins[:, 0] * 2.0 + rng.normal(size=200)
    hat, out = fit_rows(bins, np.ones(200, bool), y, np.arange(200), model)
    times = sum(weights(model, t, np.arange(200)) == 0 for t in range(model.rounds))
    assert (np.isnan(out) == (times == 0)).all()
    one = TreeModel(0, (0, 1), rounds=1, depth=6, min_rows=1, penalty=0.0, bagging=True)
    single, unseen = fit_rows(bins, np.ones(200, bool), y, np.arange(200), one)
    missed = weights(one, 0, np.arange(200)) == 0
    assert (np.isnan(unseen) == ~missed).all() and (unseen[missed] == single[missed]).all()
    assert np.sqrt(np.nanmean((out - y) ** 2)) > np.sqrt(np.mean((hat - y) ** 2))


def test_no_rows_and_unknown_targets(spark):
    models = [TreeModel(0, (0,), rounds=2)]
    empty = spark.createDataFrame([], SCHEMA)
    assert fit_models(empty, models).collect() == []
    rows = spark.createDataFrame([("a", 1, True, b"\x01", [None], [1.0]), ("a", 2, False, b"\x00", [None], [2.0])], SCHEMA)
    for key_rows in (100, 0):
        assert all(math.isnan(r["hat"][0]) for r in fit_models(rows, models, key_rows=key_rows).collect())


def test_bins_keep_the_order_of_values(spark):
    rng = random.Random(4)
    rows = [(f"k{i % 2}", i, i % 5 > 0, [1.0], [], rng.choice([1.0, 2.5, -3.0, 1e9]), rng.random()) for i in range(900)]
    df = materialise(spark.createDataFrame(rows, "key string, row bigint, train boolean, y array<double>, extra array<double>, a double, `b.c` double"))
    edges = bin_edges(df, ["a", "b.c"], 64)
    assert [len(e) for e in edges["k0"]] == [3, 63] and edges["k1"][0].tolist() == [-1.0, 1.75, 500000001.25]
    got = {r["row"]: tuple(r["bins"]) for r in binned(df, ["a", "b.c"], edges).collect()}
    for key in ("k0", "k1"):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[6])
        placed = [got[r[1]][1] for r in mine]
        assert placed == sorted(placed) and max(placed) == 63
        assert {r[5]: got[r[1]][0] for r in mine} == {-3.0: 0, 1.0: 1, 2.5: 2, 1e9: 3}


def slots(spark, n=240, seed=6):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        hour, temp = 3 * (i % 8), None if rng.random() < 0.25 else float(rng.normal(10 + i % 8, 4))
        p0 = 50.0 + hour + (temp or 0) * 2 + rng.normal()
        rows.append((i, ["January", "March"][i * 2 // n], hour, temp, float(rng.exponential(3)), p0, p0 + 1 + rng.normal(), p0 - 1 + rng.normal()))
    df = spark.createDataFrame(rows, "i int, Month string, Hour int, temp double, rr_3h double, P0 double, P1 double, P2 double")
    return materialise(df.selectExpr("timestamp_seconds(1700000000 + i * 10800) AS datetime", "Month", "Hour", "temp", "rr_3h", "P0", "P1", "P2", "P1 - P0 AS DP1", "P2 - P0 AS DP2"))


SETS = {"hour": FeatureSet([], [], ["Hour"]), "numbers": FeatureSet(["Month"], ["temp", "rr_3h"], ["Hour"])}


def test_sweep_equals_one_fit_at_a_time(spark):
    """Splits, statistics, masks and errors against separate fits of group means with the other learner."""
    data, one = slots(spark), Boosting(rounds=1, step=1.0, min_rows=1, depth=12)
    sets = {"hour": SETS["hour"], "month": FeatureSet(["Month"], [], [])}
    a = {(r["scenario"], r["repeat"]): r for r in many.sweep(data, one, seeds=[3, 4], sets=sets, penalty=0.0).collect()}
    b = {(r["scenario"], r["repeat"]): r for r in evaluate.scenario_sweep(data, one, seeds=[3, 4], sets=sets).collect()}
    assert a.keys() == b.keys() and len(a) == 4
    assert all(abs(a[k][m] - b[k][m]) < 1e-6 for k in a for m in ("n", "mape", "rmse", "mae"))


def test_preparations_matter(spark):
    """Imputation and scaling change what a tree can tell apart, so each preparation has errors of its own."""
    data, boost = slots(spark), Boosting(rounds=20, step=0.3, min_rows=3, depth=6)
    errors = {p: {r["repeat"]: r["mape"] for r in many.sweep(data, boost, seeds=[1, 2], sets={"numbers": SETS["numbers"]}, preparation=p).collect()} for p in PREPARATIONS}
    assert len({tuple(round(v, 9) for _, v in sorted(e.items())) for e in errors.values()}) >= 3
    assert errors["scale_group"] != errors["impute_global_scale_global"] != errors["impute_group"]


def test_statistics_of_all_splits_at_once(spark):
    """One fit over all repeats gives each repeat what a fit of its own gives."""
    data = slots(spark)
    long = materialise(many.split_rows(data, "datetime", [1, 2, 3], fixed.HOLDOUT_TRAIN_SHARE))
    assert long.count() == 3 * data.count() and long.where("train").count() == 3 * math.floor(0.79 * data.count())
    for spec in (lambda w: Standardiser(["temp", "rr_3h"], w), lambda w: Standardiser(["temp"], [*w, "Month", "Hour"]),
                 lambda w: GroupImputeGlobalScale(["temp", "rr_3h"], ["Month", "Hour"], within=w), lambda w: GroupImputeGlobalScale(["temp"], ["Hour"], rescale=False, within=w)):
        every = spec(["repeat"]).fit(long.where("train")).transform(long)
        for seed in (1, 2, 3):
            mine = long.where(f"repeat = {seed}")
            own = spec([]).fit(mine.where("train")).transform(mine)
            a, b = ({(r["datetime"]): (r["temp"], r["rr_3h"]) for r in d.collect()} for d in (every.where(f"repeat = {seed}"), own))
            assert a.keys() == b.keys()
            assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for k in a for x, y in zip(a[k], b[k]))


def test_splits_without_rows_on_a_side(spark):
    data = slots(spark, n=3)
    for share, n in ((0.0, 0), (1.0, 3), (0.4, 1)):
        assert many.split_rows(data, "datetime", [5], share).where("train").count() == n


def test_nan_in_training_rows_is_not_known(spark):
    df = spark.createDataFrame([(1, 1.0), (1, math.nan), (1, 3.0), (2, None)], "k int, x double")
    assert sorted((r["x"] for r in Standardiser(["x"], center=False, scale=False).fit(df).transform(df.where("x is null")).collect())) == [2.0]
    inf = spark.createDataFrame([(1, math.inf), (1, 1.0)], "k int, x double")
    assert Standardiser(["x"]).fit(inf).transform(inf).count() == 2


def test_forecast_and_its_errors(spark):
    data = slots(spark)
    cut = 1700000000 + 200 * 10800
    train, ahead = data.where(f"unix_seconds(datetime) < {cut}"), data.where(f"unix_seconds(datetime) >= {cut}")
    boost = Boosting(rounds=40, step=0.2, min_rows=3, depth=6)
    got = many.predict_ahead(train, ahead.select("datetime", "Month", "Hour", "temp", "rr_3h"), SETS, boost, "impute_group")
    assert got.columns == ["scenario", "datetime", *fixed.TARGETS] and got.count() == 80
    reality = data.selectExpr("inline(array(" + ", ".join(f"named_struct('datetime', datetime + INTERVAL {k} HOUR, 'reality', P{k})" for k in range(3)) + "))")
    errors = {r["scenario"]: r for r in many.forecast_errors(train, ahead, reality, SETS, boost, "impute_group").collect()}
    assert errors["numbers"]["n"] == 120 and errors["numbers"]["mape"] < errors["hour"]["mape"]


def test_models_need_a_byte_for_each_bin(spark):
    with pytest.raises(ValueError):
        bin_edges(spark.createDataFrame([], "key string, train boolean, a double"), ["a"], 256)
