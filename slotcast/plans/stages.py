"""Preparation as a pipeline stage that is saved and loaded with the models behind it."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame

from slotcast import fixed
from slotcast.operators.clean import require
from slotcast.operators.encode import OneHot, OneHotModel
from slotcast.operators.scaling import GroupImputeGlobalScaleModel, Standardiser, StandardiserModel
from slotcast.plans.features import FeatureSet, fitted_scaler
from slotcast.plans.models import Boosting, Forest, as_doubles, run_parallel
from slotcast.session import materialise, release


class Preparation(Transformer, MLReadable, MLWritable):
    """Fitted imputation, scaling and one-hot columns: raw slots to model columns. Other columns stay."""

    def __init__(self, scalers: list[StandardiserModel] | None = None, encoder: OneHotModel | None = None, columns: list[str] | None = None) -> None:
        super().__init__()
        self.scalers, self.encoder, self.columns = list(scalers or []), encoder, list(columns or [])

    @staticmethod
    def fit(train: DataFrame, features: FeatureSet, preparation: str = "scale_group", by: list[str] | None = None) -> Preparation:
        scaler = fitted_scaler(train, features.numerics, preparation, by)
        encoder = OneHot(features.factors, remove=False).fit(train)
        steps = [scaler.imputer, scaler.scaler] if isinstance(scaler, GroupImputeGlobalScaleModel) else [scaler]
        numbers = [c for c in features.numerics if c in scaler.columns]
        return Preparation(steps, encoder, [*numbers, *encoder.columns, *features.others])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        for scaler in self.scalers:
            dataset = scaler.transform(dataset)
        return as_doubles(self.encoder.transform(dataset), self.columns)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    """Settings as JSON in the metadata, the statistics of each scaler as a table beside it."""

    def __init__(self, stage: Preparation) -> None:
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        stage = self.stage
        content = {
            "columns": stage.columns,
            "scalers": [{"spec": asdict(s.spec), "columns": s.columns, "groups": s.groups, "constants": s.constants, "table": s.stats is not None} for s in stage.scalers],
            "levels": stage.encoder.levels, "names": [[v, level, column] for (v, level), column in stage.encoder.names.items()], "remove": stage.encoder.remove,
        }
        DefaultParamsWriter.saveMetadata(stage, path, self.sparkSession, extraMetadata={"content": json.dumps(content)})
        for k, scaler in enumerate(stage.scalers):
            if scaler.stats is not None:
                scaler.stats.write.parquet(f"{path}/statistics-{k}")


class _Reader(MLReader):
    def load(self, path: str) -> Preparation:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        content = json.loads(metadata["content"])
        scalers = [
            StandardiserModel(
                Standardiser(**s["spec"]), s["columns"], self.sparkSession.read.parquet(f"{path}/statistics-{k}") if s["table"] else None, s["groups"],
                {c: tuple(v) for c, v in s["constants"].items()},
            ) for k, s in enumerate(content["scalers"])
        ]
        encoder = OneHotModel(content["levels"], {(v, level): column for v, level, column in content["names"]}, content["remove"])
        stage = Preparation(scalers, encoder, content["columns"])
        stage._resetUid(metadata["uid"])
        return stage


def fit_pipeline(train: DataFrame, features: FeatureSet, learner: Boosting | Forest, preparation: str = "scale_group", targets: list[str] | None = None,
                 by: list[str] | None = None, parallelism: int = 3) -> PipelineModel:
    """Preparation and a model for each target in one pipeline, which takes raw slots and adds a column ``<target>_hat`` each.

    It can be saved and loaded as any pipeline: ``model.write().save(path)``, ``PipelineModel.load(path)``.
    """
    targets = targets or fixed.TARGETS
    front = Preparation.fit(train, features, preparation, by)
    assembler = VectorAssembler(inputCols=front.columns, outputCol="features")
    rows = materialise(assembler.transform(front.transform(train)).select("features", *targets))
    try:
        models = run_parallel(train.sparkSession, [lambda t=t: learner.estimator(t).fit(require(rows, [t]).select("features", t)) for t in targets], parallelism)
    finally:
        release(rows)
    return PipelineModel(stages=[front, assembler, *models])
