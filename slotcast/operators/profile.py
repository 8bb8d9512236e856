"""Descriptive statistics: group profiles, null profile, summaries, box-plot numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotcast.functions.quoting import name, text
from slotcast.operators.fold import unpivot_measures
from slotcast.operators.levels import levels_in_order_seen
from slotcast.operators.quantiles import box_counts, exact_quantiles

QUARTILES = [0.25, 0.5, 0.75]


def group_profile(df: DataFrame, keys: list[str], value: str = "puissance") -> DataFrame:
    """Rows, mean and sample standard deviation per group."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("moy_puiss"),
        F.stddev_samp(value).alias("std_puiss"),
    )


def first_seen_rank(df: DataFrame, label: str, time: str = "datetime") -> DataFrame:
    """Levels in their order of first appearance, as ``label`` and ``level``, a written table; a NULL label is none."""
    ordered = levels_in_order_seen(df, label, time).table
    return ordered.select(F.col("level").alias(label), (F.col("index") + 1).cast("int").alias("level"))


def crosstab(df: DataFrame, row: str, column: str, levels: list[str], value: str) -> DataFrame:
    """Two-way table: mean and standard deviation of ``value``, NULL for empty cells."""
    return df.groupBy(row).pivot(column, levels).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )


def _rows_per_column(one_row: DataFrame, columns: list[str], fields: list[str]) -> DataFrame:
    """Turn one wide row with columns ``<field>_<i>`` into one row per profiled column."""
    entries = [
        f"struct({text(c)} AS variable, {', '.join(f'{f}_{i} AS {f}' for f in fields)})" for i, c in enumerate(columns)
    ]
    return one_row.selectExpr(f"inline(array({', '.join(entries)}))")


def null_profile(df: DataFrame, simplify: bool = True, pareto: bool = True) -> DataFrame:
    """Number and share of NULLs per column, from one pass over the table.

    ``simplify`` leaves out columns without NULLs; ``pareto`` adds ``place``, the order by
    falling share and then name (else by name).
    """
    columns = df.columns
    counts = []
    for i, c in enumerate(columns):
        counts.append(F.expr(f"count_if({name(c)} IS NULL) AS nb_na_{i}"))
        counts.append(F.expr(f"avg(double({name(c)} IS NULL)) AS p_na_{i}"))
    out = _rows_per_column(df.agg(*counts), columns, ["nb_na", "p_na"])
    if simplify:
        out = out.filter(F.col("nb_na") >= 1)
    order = [F.desc("p_na"), F.asc("variable")] if pareto else [F.asc("variable")]
    # one row per column of the table
    return out.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and sample standard deviation per column."""
    parts = [F.expr(f"{f}({name(c)}) AS {field}_{i}") for i, c in enumerate(columns)
             for f, field in (("avg", "mean"), ("stddev_samp", "sd"))]
    return _rows_per_column(df.agg(*parts), columns, ["mean", "sd"])


def table_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum, quartiles, mean, maximum, standard deviation and NULL count per column."""
    return exact_quantiles(df, columns, QUARTILES, moments=True).selectExpr(
        "variable", "min", "q0 AS q1", "q1 AS median", "mean", "q2 AS q3", "max", "sd", "rows - n AS nulls")


def _boxed(df: DataFrame, columns: list[str], reach: float) -> DataFrame:
    """Known values beside the quartiles and fences of their column."""
    boxes = exact_quantiles(df, columns, QUARTILES).selectExpr(
        "variable AS k_variable", "q0 AS q1", "q1 AS median", "q2 AS q3",
        f"q0 - {reach!r}D * (q2 - q0) AS low_fence", f"q2 + {reach!r}D * (q2 - q0) AS high_fence")
    long = unpivot_measures(df, [], columns).filter("value IS NOT NULL")
    # one box per column of the table
    return long.join(F.broadcast(boxes), F.col("variable") == F.col("k_variable"))


def box_numbers(df: DataFrame, columns: list[str], reach: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends (last values within ``reach`` box lengths) and outlier count, from two passes over the table."""
    found = box_counts(df, columns, reach)
    if found is not None:
        return found
    inside = "value BETWEEN low_fence AND high_fence"
    return _boxed(df, columns, reach).groupBy("variable", "q1", "median", "q3").agg(
        F.expr(f"min(CASE WHEN {inside} THEN value END) AS whisker_low"),
        F.expr(f"max(CASE WHEN {inside} THEN value END) AS whisker_high"),
        F.expr(f"count_if(NOT ({inside})) AS outliers"),
    ).select("variable", "whisker_low", "q1", "median", "q3", "whisker_high", "outliers")


def box_outliers(df: DataFrame, columns: list[str], reach: float = 1.5) -> DataFrame:
    """The values beyond the whiskers, with how often they occur."""
    beyond = _boxed(df, columns, reach).filter("NOT (value BETWEEN low_fence AND high_fence)")
    return beyond.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("times"))
