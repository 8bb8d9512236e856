"""One tree model per target, on MLlib."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import RFormula, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotcast import fixed
from slotcast.functions.quoting import name
from slotcast.operators.clean import require
from slotcast.session import materialise, release, shared_dir


@dataclass(frozen=True)
class Boosting:
    rounds: int = 300
    step: float = 0.01
    min_rows: int = 5
    subsample: float = 1.0
    depth: int = fixed.BOOST_DEPTH
    seed: int = 1
    max_bins: int = 256  # a number is split at no more than max_bins - 1 of its quantiles, and at all values if it has fewer

    @staticmethod
    def of(preparation: str, scenario: int) -> "Boosting":
        """The fixed parameters of a feature set under a preparation."""
        if (preparation, scenario) not in fixed.BOOSTING:
            raise ValueError(f"no fixed parameters for scenario {scenario} under {preparation}; there are {Boosting.scenarios(preparation)}")
        return Boosting(*fixed.BOOSTING[preparation, scenario])

    @staticmethod
    def scenarios(preparation: str) -> list[int]:
        """The feature sets with fixed parameters under a preparation."""
        return sorted(number for name_, number in fixed.BOOSTING if name_ == preparation)

    def estimator(self, target: str) -> GBTRegressor:
        return GBTRegressor(
            labelCol=target, predictionCol=f"{target}_hat", maxIter=self.rounds, stepSize=self.step,
            maxDepth=self.depth, minInstancesPerNode=self.min_rows, subsamplingRate=self.subsample,
            maxBins=self.max_bins, maxMemoryInMB=512, checkpointInterval=25, seed=self.seed,
        )


@dataclass(frozen=True)
class Forest:
    trees: int = 500
    depth: int = 30
    min_rows: int = 5
    max_bins: int = 256
    bootstrap: bool = True
    seed: int = 1

    def estimator(self, target: str) -> RandomForestRegressor:
        return RandomForestRegressor(
            labelCol=target, predictionCol=f"{target}_hat", numTrees=self.trees, maxDepth=self.depth,
            minInstancesPerNode=self.min_rows, featureSubsetStrategy="onethird", maxBins=self.max_bins,
            bootstrap=self.bootstrap, seed=self.seed,
        )


def as_doubles(df: DataFrame, columns: list[str]) -> DataFrame:
    """Flags and counts as doubles. A value still missing after imputation (its group had
    none in training) becomes 0, the mean of a centred column."""
    numbers = set(columns)
    return df.selectExpr(*[
        f"coalesce(double({name(c)}), 0D) AS {name(c)}" if c in numbers else name(c) for c in df.columns])


def fit_formula(train: DataFrame, variables: list[str], targets: list[str], learner: "Boosting | Forest", parallelism: int = 3) -> "TargetModels":
    """Fit ``target ~ a + b`` for each target on the rows whose target is known; text variables are encoded by the formula."""
    def fit(target: str) -> PipelineModel:
        known = materialise(require(train, [target]).select(target, *variables))
        try:
            return Pipeline(stages=[formula(target, variables), learner.estimator(target)]).fit(known)
        finally:
            release(known)

    shared_dir(train.sparkSession)
    return TargetModels(dict(zip(targets, run_parallel(train.sparkSession, [lambda t=t: fit(t) for t in targets], parallelism))), variables)


def formula(target: str, variables: list[str]) -> RFormula:
    """``target ~ a + b``; text variables are encoded, the matrix is in ``features``."""
    return RFormula(formula=f"{target} ~ {' + '.join(variables)}", featuresCol="features", labelCol=f"{target}_label", handleInvalid="keep")


@dataclass(frozen=True)
class TargetModels:
    """Fitted models by target; each is a whole feature-to-prediction model."""

    models: dict[str, PipelineModel]
    columns: list[str]

    def predict(self, df: DataFrame) -> DataFrame:
        """Add one column per target, under the target's own name."""
        out = df.drop(*self.models)
        for target, model in self.models.items():
            scored = model.transform(out)
            out = scored.select(*out.columns, F.col(f"{target}_hat").alias(target))
        return out

    def save(self, spark: SparkSession, folder: str) -> None:
        run_parallel(spark, [
            lambda t=t, m=m: m.write().save(f"{folder.rstrip('/')}/{t}") for t, m in self.models.items()
        ], len(self.models))

    @staticmethod
    def load(spark: SparkSession, folder: str, targets: list[str], columns: list[str]) -> "TargetModels":
        models = run_parallel(spark, [
            lambda t=t: PipelineModel.load(f"{folder.rstrip('/')}/{t}") for t in targets
        ], len(targets))
        return TargetModels(dict(zip(targets, models)), columns)


def run_parallel(spark: SparkSession, jobs: list[Callable], parallelism: int) -> list:
    """Run independent fits at the same time, so that small jobs fill the cluster."""
    if parallelism <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]
    with ThreadPool(min(parallelism, len(jobs))) as pool:
        return pool.map(lambda run: run(), [inheritable_thread_target(spark)(job) for job in jobs])


def fit_targets(train: DataFrame, columns: list[str], targets: list[str], learner: Boosting | Forest,
                categories: list[str] | None = None, parallelism: int = 3) -> TargetModels:
    """Fit one model per target on the rows whose target is known.

    ``categories`` are text columns used as they are (indexed, not one-hot encoded). Feature
    rows are computed once and shared by all targets.
    """
    shared_dir(train.sparkSession)  # boosting cuts its lineage there
    categories = list(categories or [])
    plain = [c for c in columns if c not in categories]
    indexed = [f"{c}_index" for c in categories]
    steps: list[Estimator | VectorAssembler] = []
    if categories:
        steps.append(StringIndexer(inputCols=categories, outputCols=indexed, handleInvalid="keep",
                                   stringOrderType="alphabetAsc"))
    steps.append(VectorAssembler(inputCols=[*plain, *indexed], outputCol="features"))
    front = Pipeline(stages=steps).fit(train)
    rows = materialise(front.transform(train).select("features", *targets))

    def fit(target: str) -> PipelineModel:
        known = require(rows, [target]).select("features", target)
        return PipelineModel(stages=[*front.stages, learner.estimator(target).fit(known)])

    try:
        models = run_parallel(train.sparkSession, [lambda t=t: fit(t) for t in targets], parallelism)
    finally:
        release(rows)
    return TargetModels(dict(zip(targets, models)), columns)
