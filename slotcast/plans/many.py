"""Evaluations and forecasts that fit many tree models in the jobs of one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotcast import fixed
from slotcast.operators.combine import join_back
from slotcast.operators.fold import recompose, unfold
from slotcast.operators.metrics import error_metrics
from slotcast.operators.split import exact_splits, split_hash
from slotcast.operators.trees import KEY_ROWS, TreeModel, bin_edges, binned, fit_models
from slotcast.plans.evaluate import LEVELS, _chosen, _label, _split_table
from slotcast.plans.features import FINAL_SCENARIO, SCENARIOS, FeatureSet, prepare_many, project, union_of
from slotcast.plans.models import Boosting, Forest, as_doubles
from slotcast.session import materialise, release

Learner = Boosting | Forest


def tree_models(learner: Learner, columns: list[int], targets: int, penalty: float) -> list[TreeModel]:
    """A model for each target on the numbered columns."""
    common = {"columns": tuple(columns), "min_rows": learner.min_rows, "depth": learner.depth, "seed": learner.seed}
    if isinstance(learner, Forest):
        third = max(1, len(columns) // 3)
        return [TreeModel(t, rounds=learner.trees, penalty=0.0, bagging=learner.bootstrap, columns_drawn=third, **common) for t in range(targets)]
    return [TreeModel(t, rounds=learner.rounds, step=learner.step, subsample=learner.subsample, penalty=penalty, **common) for t in range(targets)]


def split_rows(data: DataFrame, key: str, seeds: Sequence[int], share: float) -> DataFrame:
    """``data`` once for each seed, with ``repeat`` and whether the row is on the train side of that seed's exact split (``train``)."""
    splits = exact_splits(data, key, list(seeds), share, rounding="floor")
    kind = data.schema[key].dataType
    cuts = F.array(*[
        F.struct(F.lit(s.seed).alias("repeat"), F.lit(s.cut_hash if 0 < s.train_rows < s.rows else -1 if not s.train_rows else 1 << 32).alias("hash"), F.lit(s.cut_key).cast(kind).alias("key"))
        for s in splits.values()
    ])
    long = data.withColumn("cut_", F.explode(cuts))
    h = split_hash(key, F.col("cut_.repeat"))
    tie = (h == F.col("cut_.hash")) & (F.col("cut_.key").isNull() | (F.col(key) <= F.col("cut_.key")))
    return long.withColumn("repeat", F.col("cut_.repeat")).withColumn("train", F.coalesce((h < F.col("cut_.hash")) | tie, F.lit(False))).drop("cut_")


def _tree_rows(rows: DataFrame, key: Column, columns: list[str], targets: list[str], extra: list[str], max_bins: int) -> DataFrame:
    """Binned rows for the learner; a row's number is the second it starts at."""
    shaped = materialise(as_doubles(rows, columns).select(
        key.alias("key"), F.unix_seconds(F.col("datetime").cast("timestamp")).alias("row"), "train", F.array(*[F.col(t).cast("double") for t in targets]).alias("y"),
        F.array(*[F.col(x).cast("double") for x in extra]).cast("array<double>").alias("extra"), *columns,
    ))
    out = materialise(binned(shaped, columns, bin_edges(shaped, columns, max_bins)))
    release(shaped)
    return out


def sweep(data: DataFrame, learner: Learner | None = None, seeds: Sequence[int] = range(fixed.HOLDOUT_REPEATS),
          sets: dict[int | str, FeatureSet] | None = None, preparation: str = "scale_group", by: list[str] | None = None,
          share: float = fixed.HOLDOUT_TRAIN_SHARE, penalty: float = 1.0, max_bins: int = 255, strict: bool = False, key_rows: int = KEY_ROWS) -> DataFrame:
    """Errors of repeated exact splits for several feature sets: ``scenario, repeat, n, mape, rmse, mae, preparation``.

    All repeats are rows of one table: statistics of all splits and groups come from one aggregation, nothing is stored for a split of its own, and
    all sets share one matrix of bins, of which each model sees the columns of its set. Sets and learners as in :func:`evaluate.scenario_sweep`.
    """
    sets = _chosen(sets, learner, preparation)
    every = union_of(list(sets.values()))
    long = materialise(split_rows(_split_table(data, every), "datetime", seeds, share))
    _, ready, columns = prepare_many(long.where("train"), long, sets, preparation, by, within=["repeat"])
    names = list(dict.fromkeys(c for cs in columns.values() for c in cs))
    real = [f"real_{p}" for p in LEVELS]
    rows = _tree_rows(ready, F.col("repeat").cast("string"), names, fixed.TARGETS, real, max_bins)
    models = [m for k in sets for m in tree_models(learner or Boosting.of(preparation, k), [names.index(c) for c in columns[k]], len(fixed.TARGETS), penalty)]
    found = fit_models(rows, models, key_rows).where("not train")
    each = F.array(*[
        F.struct(F.lit(_label(k)).alias("scenario"), *[F.col("hat")[len(fixed.TARGETS) * i + t].alias(target) for t, target in enumerate(fixed.TARGETS)])
        for i, k in enumerate(sets)
    ])
    wide = found.select(F.col("key").cast("int").alias("repeat"), F.timestamp_seconds("row").alias("datetime"), *[F.col("extra")[k].alias(r) for k, r in enumerate(real)], F.inline(each))
    levels = recompose(wide)
    pairs = F.array(*[F.struct(F.col(p).alias("puissance"), F.col(f"real_{p}").alias("reality")) for p in LEVELS])
    errors = error_metrics(levels.select("scenario", "repeat", F.inline(pairs)), by=["scenario", "repeat"], strict=strict)
    result = materialise(errors.select("scenario", "repeat", "n", (F.col("mape") * 100).alias("mape"), "rmse", "mae", F.lit(preparation).alias("preparation")))
    release(long, rows)
    return result


def out_of_bag(train: DataFrame, columns: list[str], learner: Forest, targets: list[str] | None = None, max_bins: int = 255, key_rows: int = KEY_ROWS) -> DataFrame:
    """``datetime`` and, for each target, the mean prediction of the trees whose bag does not hold the row; NULL where every bag does."""
    targets = targets or fixed.TARGETS
    rows = _tree_rows(train.select("datetime", F.lit(True).alias("train"), *targets, *columns), F.lit("all"), columns, targets, [], max_bins)
    found = fit_models(rows, tree_models(learner, list(range(len(columns))), len(targets), 0.0), key_rows)
    time = F.timestamp_seconds("row").cast(train.schema["datetime"].dataType).alias("datetime")
    known = [F.nanvl(F.col("out")[k], F.lit(None).cast("double")).alias(t) for k, t in enumerate(targets)]
    result = materialise(found.select(time, *known))
    release(rows)
    return result


def predict_ahead(train: DataFrame, ahead: DataFrame, sets: dict[int | str, FeatureSet], learner: Learner | None = None, preparation: str = "scale_group",
                  by: list[str] | None = None, targets: list[str] | None = None, penalty: float = 1.0, max_bins: int = 255, key_rows: int = KEY_ROWS) -> DataFrame:
    """Fit each set on ``train`` and predict ``ahead``: ``scenario``, ``datetime`` and a column for each target. Sets and learners as in :func:`sweep`."""
    sets = _chosen(sets, learner, preparation)
    targets = targets or fixed.TARGETS
    every = union_of(list(sets.values()))
    ready, asked, columns = prepare_many(project(train, every, targets), project(ahead, every), sets, preparation, by)
    names = list(dict.fromkeys(c for cs in columns.values() for c in cs))
    both = ready.select("datetime", F.lit(True).alias("train"), *targets, *names).unionByName(
        asked.select("datetime", F.lit(False).alias("train"), *[F.lit(None).cast("double").alias(t) for t in targets], *names))
    rows = _tree_rows(both, F.lit("all"), names, targets, [], max_bins)
    models = [m for k in sets for m in tree_models(learner or Boosting.of(preparation, k), [names.index(c) for c in columns[k]], len(targets), penalty)]
    found = fit_models(rows, models, key_rows).where("not train")
    each = F.array(*[
        F.struct(F.lit(_label(k)).alias("scenario"), *[F.col("hat")[len(targets) * i + t].alias(target) for t, target in enumerate(targets)]) for i, k in enumerate(sets)
    ])
    time = F.timestamp_seconds("row").cast(ahead.schema["datetime"].dataType).alias("datetime")
    result = materialise(found.select(time, F.inline(each)).select("scenario", "datetime", *targets))
    release(rows)
    return result


def forecast(train: DataFrame, ahead: DataFrame, scenario: int = FINAL_SCENARIO, learner: Learner | None = None, preparation: str = "scale_group",
             by: list[str] | None = None, chained: bool = False, **options: object) -> DataFrame:
    """Every hour of the slots ahead from models of one numbered set: ``datetime`` and ``puissance``, with the set's variables at the hours that start a slot."""
    features = SCENARIOS[scenario]
    targets = ["P0", "DP1", "DP12"] if chained else fixed.TARGETS
    slots = predict_ahead(train, ahead, {scenario: features}, learner, preparation, by, targets, **options)
    hourly = unfold(recompose(slots.drop("scenario"), chained))
    return join_back(hourly, project(ahead, features))


def forecast_errors(train: DataFrame, ahead: DataFrame, reality: DataFrame, sets: dict[int | str, FeatureSet] | None = None, learner: Learner | None = None,
                    preparation: str = "scale_group", by: list[str] | None = None, strict: bool = True, **options: object) -> DataFrame:
    """Final forecasts of several sets against ``reality(datetime, reality)``: a row for each set with its errors."""
    slots = predict_ahead(train, ahead, _chosen(sets, learner, preparation), learner, preparation, by, **options)
    hours = unfold(recompose(slots), keep=["scenario"]).join(reality, "datetime", "left")
    errors = error_metrics(hours, by=["scenario"], strict=strict)
    return errors.select("scenario", "n", (F.col("mape") * 100).alias("mape"), "rmse", "mae", F.lit(preparation).alias("preparation"))
