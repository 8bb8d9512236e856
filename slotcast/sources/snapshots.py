"""Named tables kept together as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save_tables(tables: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder.rstrip('/')}/{name}")


def load_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder.rstrip('/')}/{name}") for name in names}
