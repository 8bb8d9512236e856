"""Semicolon-delimited text, with decimal points or commas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DecimalType, DoubleType, FloatType, NumericType, StringType, StructField, StructType

from slotcast.functions.quoting import name
from slotcast.sources.records import read_records


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: StructType,
    sep: str = ";",
    header: bool = True,
    decimal: str = ".",
    missing: tuple[str, ...] = ("", "NA"),
    carried: tuple[str, ...] = (),
    line_breaks: bool = False,
) -> DataFrame:
    """Read text with an explicit schema; names come from the schema, by position.

    Numbers may use a decimal comma. The ``missing`` texts are NULL in every column, as is
    text that can not be read as the column's type. ``carried`` names partition columns of the path.
    A doubled quote inside a quoted cell is one quote. Cells may hold line breaks only with ``line_breaks``, which
    stores the lines once to count their quotes; see :func:`read_records`.
    """
    carried = list(carried)
    if line_breaks:
        options = {"sep": sep, "quote": '"', "escape": '"', "nullValue": ""}
        parsed = F.from_csv(F.col("value"), ", ".join(f"{name(n)} STRING" for n in schema.names), options).alias("cells")
        raw = read_records(spark, path, header, carried).select(parsed, *carried).select("cells.*", *carried)
    else:
        text = StructType([StructField(n, StringType()) for n in [*schema.names, *carried]])
        raw = (
            spark.read.schema(text).option("sep", sep).option("header", header)
            .option("enforceSchema", True).option("nullValue", "")
            .option("quote", '"').option("escape", '"').csv(path)
        )

    def typed(f: StructField) -> Column:
        cell = F.col(f"`{f.name}`")
        known = F.when(~F.trim(cell).isin(*missing), cell)
        if isinstance(f.dataType, NumericType):
            known = F.trim(known)
            if decimal != ".":
                known = F.replace(known, F.lit(decimal), F.lit("."))
        return known.try_cast(f.dataType).alias(f.name)

    return raw.select(*[typed(f) for f in schema.fields], *carried)


def _as_text(df: DataFrame, decimal: str) -> DataFrame:
    def cell(f: StructField) -> Column:
        text = F.col(f"`{f.name}`").cast("string")
        if decimal != "." and isinstance(f.dataType, (DecimalType, DoubleType, FloatType)):
            text = F.replace(text, F.lit("."), F.lit(decimal))
        elif isinstance(f.dataType, BooleanType):
            text = F.upper(text)
        return text.alias(f.name)

    return df.select(*[cell(f) for f in df.schema.fields])


def write_delimited(df: DataFrame, path: str, sep: str = ";", decimal: str = ",", missing: str = "NA",
                    header: bool = True, mode: str = "errorifexists", order: list[str] | None = None) -> None:
    """Write text with decimal commas and TRUE/FALSE; NULL becomes ``missing``, a quote in a cell is doubled.

    With ``order`` the rows are sorted by these columns over all files, part by part.
    """
    rows = df.orderBy(*order) if order else df
    (
        _as_text(rows, decimal).write.mode(mode).option("sep", sep).option("header", header)
        .option("nullValue", missing).option("emptyValue", "").option("quote", '"').option("escape", '"').csv(path)
    )


def write_result(df: DataFrame, base: str, label: str, time: str = "datetime") -> str:
    """Write one run's result with blank NULLs, in time order if it has a time, as partition ``run=<label>`` below ``base``."""
    path = f"{base.rstrip('/')}/run={label}"
    write_delimited(df, path, missing="", order=[time] if time in df.columns else None)
    return path


def write_submission(df: DataFrame, path: str, value: str = "puissance", time: str = "datetime", decimal: str = ".") -> None:
    """The bare values in time order: one column, no header."""
    ordered = df.orderBy(time).select(value)
    _as_text(ordered, decimal).write.option("header", False).option("nullValue", "NA").csv(path)


def read_results(spark: SparkSession, base: str, schema: StructType) -> DataFrame:
    """All runs below ``base``, with their label in column ``run``."""
    return read_delimited(spark, base, schema, decimal=",", missing=("",), carried=("run",))
