"""Joins and unions between the series and its covariates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_covariates(series: DataFrame, covariates: DataFrame, time: str = "datetime",
                    required: list[str] | None = None) -> DataFrame:
    """Right outer join on time, then only rows whose ``required`` columns are known.
    The optimizer turns the pair into an inner join when a series column is required."""
    joined = series.join(covariates, time, "right")
    return joined.dropna(subset=list(required)) if required else joined


def join_back(hourly: DataFrame, covariates: DataFrame, time: str = "datetime") -> DataFrame:
    """Left outer join: hours between two slot starts get NULL covariates."""
    return hourly.join(covariates, time, "left")


def tagged_union(train: DataFrame, test: DataFrame, tag: str = "DATA_") -> DataFrame:
    return train.withColumn(tag, F.lit("train")).unionByName(test.withColumn(tag, F.lit("test")))
