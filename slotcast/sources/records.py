"""Records of delimited text whose quoted cells may hold line breaks, read by as many tasks as a file has blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slotcast.operators.sizing import lookup_side, settle
from slotcast.session import materialise, ship_code

_BLOCK = ["file_", "start_"]


def _counted() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines with their place in the block (``line_``), whether an odd number of quotes is in them (``odd_``) and before them in the block (``before_``),
    and the number of records that open in the block up to them and go on to the next line, if the block starts outside (``open0_``) or inside (``open1_``) quotes."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen, parity, opened = None, 0, 0, [0, 0]
        for batch in batches:
            at = batch.schema.names
            file, start = batch.column(at.index("file_")).to_pylist(), batch.column(at.index("start_")).to_numpy()
            odd = pc.fill_null(pc.count_substring(batch.column(at.index("value")), '"'), 0).to_numpy(zero_copy_only=False).astype(np.int64) % 2
            edge = [0, *[i for i in range(1, len(file)) if start[i] != start[i - 1] or file[i] != file[i - 1]], len(file)]
            line, before, open_ = np.zeros(len(file), np.int64), np.zeros(len(file), np.int64), [np.zeros(len(file), np.int64) for _ in range(2)]
            for a, b in zip(edge[:-1], edge[1:]):
                if a == b:
                    continue
                if (file[a], start[a]) != block:
                    block, seen, parity, opened = (file[a], start[a]), 0, 0, [0, 0]
                line[a:b] = seen + np.arange(b - a)
                total = parity + np.cumsum(odd[a:b])
                before[a:b] = (total - odd[a:b]) % 2
                for inside in range(2):
                    opens = (before[a:b] == inside) & (odd[a:b] == 1)
                    open_[inside][a:b] = opened[inside] + np.cumsum(opens)
                    opened[inside] = int(open_[inside][b - 1])
                seen, parity = seen + b - a, int(total[-1]) % 2
            added = [pa.array(v) for v in (line, odd, before, *open_)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*at, "line_", "odd_", "before_", "open0_", "open1_"])

    return step


def read_records(spark: SparkSession, path: str, header: bool, carried: list[str]) -> DataFrame:
    """``value``, the text of each record with its line breaks, and the ``carried`` partition columns of the path.

    A line break is inside a cell if an odd number of quotes comes before it in the file; a doubled quote counts twice. Each task counts the quotes of its
    blocks; the parity of all blocks before, a row for each block, tells whether a block starts inside quotes. Lines that are records of their own,
    usually nearly all, never move; only lines of records that span lines are brought together by record, over block ends too.
    Line ends inside cells become line feeds, blank records are left out, and a quote that is never closed makes the rest of its file one record.
    """
    lines = ship_code(spark).read.text(path)
    place = [F.col("_metadata.file_path").alias("file_"), F.col("_metadata.file_block_start").alias("start_")]
    raw = lines.select("value", *[F.col(f"`{c}`").cast("string").alias(c) for c in carried], *place)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in raw.schema.fields)
    # written once, so that no later scan cuts files in another way
    counted = materialise(raw.mapInArrow(_counted(), f"{schema}, line_ bigint, odd_ bigint, before_ bigint, open0_ bigint, open1_ bigint"))
    sums = counted.groupBy(*_BLOCK).agg((F.sum("odd_") % 2).alias("parity_"), F.max("open0_").alias("most0_"), F.max("open1_").alias("most1_"))
    earlier = Window.partitionBy("file_").orderBy("start_").rowsBetween(Window.unboundedPreceding, -1)
    told = sums.withColumn("inside_", F.coalesce(F.sum("parity_").over(earlier) % 2, F.lit(0)))
    most = F.when(F.col("inside_") == 0, F.col("most0_")).otherwise(F.col("most1_"))
    last = F.when(most > 0, F.struct(F.col("start_").alias("start"), most.alias("open")))
    # a row for each block; what is open at its start began in the last block before in which a record opens
    blocks = told.withColumn("last_", last).select(
        F.col("file_").alias("k_file_"), F.col("start_").alias("k_start_"), "inside_", F.last("last_", True).over(earlier).alias("carry_"), (F.col("start_") == F.min("start_").over(Window.partitionBy("file_"))).alias("first_"))
    table, n = settle(blocks)
    joined = counted.join(lookup_side(table, n), (F.col("file_") == F.col("k_file_")) & (F.col("start_") == F.col("k_start_")))
    begins = F.col("before_") == F.col("inside_")
    own = F.when(F.col("inside_") == 0, F.col("open0_")).otherwise(F.col("open1_"))
    marked = joined.withColumn("begins_", begins).withColumn("own_", own).withColumn("head_", begins & F.col("first_") & (F.col("line_") == 0))
    single = marked.where("begins_ AND odd_ = 0").select("value", "head_", *carried)
    key = F.when(F.col("own_") > 0, F.struct(F.col("start_").alias("start"), F.col("own_").alias("open"))).otherwise(F.col("carry_"))
    spread = marked.where("NOT (begins_ AND odd_ = 0)").withColumn("record_", key)
    parts = F.array_sort(F.collect_list(F.struct("start_", "line_", "value")))
    several = spread.groupBy("file_", "record_", *carried).agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"), F.max("head_").alias("head_"))
    every = single.unionByName(several.select("value", "head_", *carried))
    kept = every.where("trim(value) <> ''")
    return (kept.where("NOT head_") if header else kept).select("value", *carried)
