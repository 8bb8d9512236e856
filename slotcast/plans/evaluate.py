"""Hold-out evaluation, scenario sweeps and the final forecast."""

from __future__ import annotations

import math
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast import fixed
from slotcast.operators.combine import join_back
from slotcast.operators.fold import recompose, unfold
from slotcast.operators.metrics import error_metrics, with_row_error
from slotcast.operators.split import Split, exact_splits
from slotcast.plans.features import FINAL_SCENARIO, SCENARIOS, FeatureSet, prepare, prepare_many, project, union_of
from slotcast.plans.models import Boosting, Forest, TargetModels, as_doubles, fit_targets, run_parallel
from slotcast.session import materialise, release
from slotcast.sources.delimited import write_result

LEVELS = ["P0", "P1", "P2"]


def fit_predict(train: DataFrame, test: DataFrame, features: FeatureSet, learner: Boosting | Forest,
                preparation: str = "scale_group", targets: list[str] | None = None,
                by: list[str] | None = None, keep: list[str] | None = None,
                parallelism: int = 3) -> tuple[DataFrame, TargetModels]:
    """Prepare, fit and predict; returns ``keep`` columns with one prediction per target."""
    targets = targets or fixed.TARGETS
    ready, asked, columns = prepare(train, test, features, preparation, by)
    models = fit_targets(as_doubles(ready, columns), columns, targets, learner, parallelism=parallelism)
    kept = ["datetime", *(keep or [])]
    return models.predict(as_doubles(asked, columns).drop(*targets)).select(*kept, *targets), models


def level_pairs(predicted: DataFrame) -> DataFrame:
    """One row per slot and hour with ``puissance`` and ``reality``, given predicted P0, DP1, DP2
    and observed levels in columns ``real_P0``, ``real_P1``, ``real_P2``."""
    levels = recompose(predicted)
    pairs = [F.struct(F.lit(k).alias("hour"), F.col(p).alias("puissance"), F.col(f"real_{p}").alias("reality"))
             for k, p in enumerate(LEVELS)]
    return levels.select("datetime", F.inline(F.array(*pairs)))


def _split_table(data: DataFrame, features: FeatureSet) -> DataFrame:
    levels = [F.col(p).alias(f"real_{p}") for p in LEVELS]
    return data.select("datetime", *fixed.TARGETS, *levels, *features.variables)


RESULTS = "scenario string, repeat int, n bigint, mape double, rmse double, mae double"


def _errors(models: TargetModels, test: DataFrame, columns: list[str], scenario: str, seed: int, strict: bool) -> tuple:
    """One row of the results table."""
    asked = test.select("datetime", *[f"real_{p}" for p in LEVELS], *columns)
    row = error_metrics(level_pairs(models.predict(as_doubles(asked, columns))), strict=strict).first()
    return scenario, seed, row["n"], None if row["mape"] is None else row["mape"] * 100, row["rmse"], row["mae"]


def repeated_holdout(data: DataFrame, features: FeatureSet, learner: Boosting | Forest,
                     seeds: Sequence[int] = range(fixed.HOLDOUT_REPEATS),
                     scenario: str = "final", preparation: str = "scale_group", by: list[str] | None = None,
                     share: float = fixed.HOLDOUT_TRAIN_SHARE, parallelism: int = 2,
                     strict: bool = False) -> DataFrame:
    """Errors of repeated exact splits: one row per seed with MAPE (percent), RMSE and MAE.

    ``data`` has the targets, the levels P0, P1, P2 and the variables; it is read many times,
    so pass a stored table.
    """
    splits = exact_splits(_split_table(data, features), "datetime", list(seeds), share, rounding="floor")

    def one(split: Split) -> tuple:
        train, test, columns = prepare(split.train, split.test, features, preparation, by)
        models = fit_targets(as_doubles(train, columns), columns, fixed.TARGETS, learner)
        return _errors(models, test, columns, scenario, split.seed, strict)

    rows = run_parallel(data.sparkSession, [lambda s=s: one(s) for s in splits.values()], parallelism)
    return data.sparkSession.createDataFrame(rows, RESULTS)


def scenario_sweep(data: DataFrame, learner: Boosting | Forest | None = None,
                   seeds: Sequence[int] = range(fixed.HOLDOUT_REPEATS),
                   sets: dict[int | str, FeatureSet] | None = None, preparation: str = "scale_group",
                   by: list[str] | None = None, share: float = fixed.HOLDOUT_TRAIN_SHARE,
                   parallelism: int = 2, strict: bool = False) -> DataFrame:
    """Repeated hold-out for several feature sets, with the rows of :func:`repeated_holdout`.

    Imputation, scaling and one-hot columns of a variable do not depend on the other variables, so each split
    is prepared once, for all variables of all sets. ``parallelism`` prepared splits are stored at a time and deleted after
    their fits. Without ``sets`` these are the numbered ones (without a learner those with fixed parameters
    for the preparation); without a learner each uses its own fixed boosting parameters.
    """
    sets = _chosen(sets, learner, preparation)
    splits = exact_splits(_split_table(data, union_of(list(sets.values()))), "datetime", list(seeds), share, rounding="floor")
    spark = data.sparkSession

    def prepared(split: Split) -> tuple[Split, DataFrame, DataFrame, dict[int | str, list[str]]]:
        train, test, columns = prepare_many(split.train, split.test, sets, preparation, by)
        return split, materialise(train), materialise(test), columns

    def one(key: int | str, split: Split, train: DataFrame, test: DataFrame, columns: list[str]) -> tuple:
        model = learner or Boosting.of(preparation, key)
        wanted = train.select(*fixed.TARGETS, *columns)
        models = fit_targets(as_doubles(wanted, columns), columns, fixed.TARGETS, model, parallelism=1)
        return _errors(models, test, columns, _label(key), split.seed, strict)

    rows, waiting = [], list(splits.values())
    for start in range(0, len(waiting), max(1, parallelism)):
        ready = run_parallel(spark, [lambda s=s: prepared(s) for s in waiting[start : start + max(1, parallelism)]], parallelism)
        rows += run_parallel(spark, [
            lambda k=k, split=split, train=train, test=test, columns=columns: one(k, split, train, test, columns[k])
            for split, train, test, columns in ready for k in sets
        ], parallelism)
        release(*[table for _, train, test, _ in ready for table in (train, test)])
    return spark.createDataFrame(rows, RESULTS).withColumn("preparation", F.lit(preparation))


def _chosen(sets: dict[int | str, FeatureSet] | None, learner: Boosting | Forest | None, preparation: str) -> dict[int | str, FeatureSet]:
    if sets is not None:
        return sets
    return {n: SCENARIOS[n] for n in (SCENARIOS if learner else Boosting.scenarios(preparation))}


def _label(key: int | str) -> str:
    return f"scenario {key}" if isinstance(key, int) else key


def forecast(train: DataFrame, ahead: DataFrame, scenario: int = FINAL_SCENARIO,
             learner: Boosting | Forest | None = None, preparation: str = "scale_group",
             by: list[str] | None = None, chained: bool = False) -> tuple[DataFrame, TargetModels]:
    """Fit on all training slots and predict every hour of the slots ahead: ``datetime`` and
    ``puissance``, with the scenario's variables at the hours that start a slot."""
    features = SCENARIOS[scenario]
    targets = ["P0", "DP1", "DP12"] if chained else fixed.TARGETS
    learner = learner or Boosting.of(preparation, scenario)
    slots, models = fit_predict(project(train, features, targets), project(ahead, features), features, learner,
                                preparation, targets, by)
    hourly = unfold(recompose(slots, chained))
    return join_back(hourly, project(ahead, features)), models


def forecast_sweep(train: DataFrame, ahead: DataFrame, reality: DataFrame, learner: Boosting | Forest | None = None,
                   sets: dict[int | str, FeatureSet] | None = None, preparation: str = "scale_group", by: list[str] | None = None,
                   base: str | None = None, job: str = "forecast", parallelism: int = 2,
                   strict: bool = True) -> DataFrame:
    """Final forecasts of several feature sets against ``reality(datetime, reality)``; sets as in :func:`scenario_sweep`.

    One row per set with its errors. With ``base`` each forecast is also written there in time order,
    with row errors and the set's variables, under a run label of time, job and error.
    """
    sets = _chosen(sets, learner, preparation)
    every = union_of(list(sets.values()))
    ready, asked, columns = prepare_many(
        project(train, every, fixed.TARGETS), project(ahead, every), sets, preparation, by)
    ready, asked = materialise(ready), materialise(asked)
    spark = train.sparkSession

    def one(key: int | str) -> tuple:
        model = learner or Boosting.of(preparation, key)
        wanted = ready.select(*fixed.TARGETS, *columns[key])
        models = fit_targets(as_doubles(wanted, columns[key]), columns[key], fixed.TARGETS, model, parallelism=1)
        slots = models.predict(as_doubles(asked.select("datetime", *columns[key]), columns[key]))
        hourly = unfold(recompose(slots.select("datetime", *fixed.TARGETS))).join(reality, "datetime", "left")
        scored = materialise(with_row_error(hourly.select("datetime", "puissance", "reality")))
        row = error_metrics(scored, strict=strict).first()
        mape = None if row["mape"] is None else row["mape"] * 100
        if base is not None:
            label = f"{time.strftime('%Y%m%d_%H%M')}_{job}{key}_{mape if mape is not None else math.nan:.3f}"
            write_result(join_back(scored, project(ahead, sets[key])), base, label)
        release(scored)
        return _label(key), 0, row["n"], mape, row["rmse"], row["mae"]

    rows = run_parallel(spark, [lambda k=k: one(k) for k in sets], parallelism)
    release(ready, asked)
    return spark.createDataFrame(rows, RESULTS).withColumn("preparation", F.lit(preparation))
