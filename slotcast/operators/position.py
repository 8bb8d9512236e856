"""Row positions without a single-partition sort, and joins by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from slotcast.operators.sizing import lookup_side, settle
from slotcast.session import fresh_path, materialise


def _part(file: str) -> Column:
    """The number of a written part, so that part 100000 comes after part 99999."""
    return F.regexp_extract(file, "part-([0-9]+)", 1).try_cast("int")


def with_position(df: DataFrame, ties: list[str], time: str = "datetime", position: str = "position") -> DataFrame:
    """Zero-based place of each row in time order; ``ties`` order rows of equal time and let
    them spread over several files. Pass an empty list only where times are unique.

    The rows are range-partitioned by time, sorted and written to the shared folder; a row's
    place is its index in its file plus the rows of all earlier files. No task ranks more than
    its own file.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "ordered")
    df.orderBy(time, *ties).write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).select(
        "*", F.col("_metadata.file_name").alias("file_"), F.col("_metadata.row_index").alias("index_"))
    files = rows.groupBy("file_").agg(F.count(F.lit(1)).alias("rows_"))
    # one row per file
    before = F.sum("rows_").over(Window.orderBy(_part("file_"), "file_")) - F.col("rows_")
    offsets, count = settle(files.select(F.col("file_").alias("k_file"), before.alias("before_")))
    joined = rows.join(lookup_side(offsets, count), F.col("file_") == F.col("k_file"))
    return joined.select(*df.columns, (F.col("before_") + F.col("index_")).alias(position))


def read_positions(spark: SparkSession, path: str, schema: StructType | str, sep: str = ";",
                   position: str = "position") -> DataFrame:
    """A headerless delimited file with the zero-based line position of every row.

    Each file block is read in order by one task, so a row's place is its offset in the block
    plus the rows of all earlier blocks (by part number, file name, then block start). The rows are written
    once with file, block and number, and both the offsets and the result come from there, so a later scan can not cut
    the files in another way. Only one row per block is shuffled.
    """
    raw = spark.read.schema(schema).option("sep", sep).csv(path)
    fields = raw.columns
    rows = materialise(raw.select(
        *fields,
        F.col("_metadata.file_path").alias("file_"),
        F.col("_metadata.file_block_start").alias("start_"),
        F.monotonically_increasing_id().alias("id_"),
    ))
    blocks = rows.groupBy("file_", "start_").agg(F.min("id_").alias("first_"), F.count(F.lit(1)).alias("rows_"))
    before = F.sum("rows_").over(Window.orderBy(_part("file_"), "file_", "start_")) - F.col("rows_")
    offsets, count = settle(blocks.select(
        F.col("file_").alias("k_file"), F.col("start_").alias("k_start"), "first_", before.alias("before_")))
    side = lookup_side(offsets, count)
    joined = rows.join(side, (F.col("file_") == F.col("k_file")) & (F.col("start_") == F.col("k_start")))
    return joined.select(*fields, (F.col("before_") + F.col("id_") - F.col("first_")).alias(position))


def attach_by_position(df: DataFrame, values: DataFrame, column: str, after: str, position: str = "position") -> DataFrame:
    """Join ``values(position, column)`` to rows with a position; the new column comes after ``after``."""
    names = [c for c in df.columns if c != position]
    at = names.index(after) + 1
    joined = df.join(values.select(position, column), position, "left")
    return joined.select(*names[:at], column, *names[at:])
