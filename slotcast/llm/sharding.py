"""Shards of bounded size by extendible hashing."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotcast.llm.common import fresh, positional
from slotcast.operators.sizing import lookup_side, settle
from slotcast.session import materialise, release

BITS = 60
LIMIT = 1 << 20
STEP = 6
SALTS = 1024


def hash_bits(value: Column) -> Column:
    """The first 60 bits of the MD5 sum of a text, as a number; NULL counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _digits(column: str) -> Column:
    return F.lpad(F.conv(F.col(column).cast("string"), 10, 2), BITS, "0")


def _leaves(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """``(prefix, depth, total)`` for every prefix of ``high`` bits: the least depth from ``low`` on at which its bucket
    fits the limit, or NULL."""
    fine = rows.groupBy(F.substring("_bits", 1, high).alias("prefix")).agg(
        F.sum("size").alias("total"), F.min("_bits").alias("first"), F.max("_bits").alias("last")
    )
    fine = materialise(fine)
    levels = fine.select("prefix", "total", "first", "last", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn("bucket", F.expr("substring(prefix, 1, depth)"))
    fits = levels.groupBy("depth", "bucket").agg(F.sum("total").alias("total"), F.min("first").alias("first"), F.max("last").alias("last")).where(
        (F.col("total") <= limit) | (F.col("first") == F.col("last"))
    )
    fits = materialise(fits.select("depth", "bucket", F.col("total").alias("held")))
    found = levels.select("prefix", "depth", "bucket").join(fits, ["depth", "bucket"])
    best = found.groupBy("prefix").agg(F.min(F.struct("depth", "held")).alias("leaf"))
    return materialise(best.select("prefix", F.col("leaf.depth").alias("depth"), F.col("leaf.held").alias("held")))


def shard(docs: DataFrame, key: Column, size: Column, tie: Column, id_column: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """``(id, shard, depth, page, size)`` of every row. ``shard`` is a prefix of the bits of the hashed ``key``, then of ``tie``.

    A directory of prefixes starts with the whole table; only a bucket with more than ``limit`` bytes is split on its next
    bit, until every bucket fits. Rows of one hot key go on splitting by the hash of ``tie`` (a text, say). Rows equal
    in both fill numbered pages of their shard, so a shard's page fits the limit; a single row above the limit has a page of its own.
    NULL sizes count 0 and NULL keys as empty texts. An empty table gives no shards.

    Bytes are added up by fine prefixes before any shuffle, the directory comes from these sums, and texts are never moved.
    Rows join the directory on the prefix, whose size is even by hashing; only hot keys go on to the next round.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    rows = materialise(docs.select(F.col(f"`{id_column}`").alias("id"), hash_bits(key).alias("_h"), hash_bits(tie).alias("_t"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("size"), F.monotonically_increasing_id().alias("_row")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    low, high = 0, min(2 * BITS, max(1, math.ceil(math.log2(max(1.0, total / limit))) + 3))
    left = rows.withColumn("_bits", F.concat(_digits("_h"), _digits("_t")))
    done: list[DataFrame] = []
    while True:
        leaves = _leaves(left, low, high, limit)
        joined = left.withColumn("prefix", F.substring("_bits", 1, high)).join(leaves, "prefix", "left").drop("prefix")
        done.append(joined.where("depth is not null"))
        more = joined.where("depth is null").drop("depth", "held")
        left = materialise(more)
        if left.isEmpty():
            break
        # one key is left in each bucket: its own bits cannot part it any more
        single = left.groupBy(F.substring("_bits", 1, high).alias("p")).agg(F.min("_h").alias("a"), F.max("_h").alias("b")).where("a < b").isEmpty()
        low = max(high, BITS) if single else high
        high = min(2 * BITS, low + STEP)
    placed = reduce(DataFrame.union, done).withColumn("shard", F.expr("substring(_bits, 1, depth)"))
    fitting = placed.where(F.col("held") <= limit).select("id", "shard", "depth", F.lit(0).cast("long").alias("page"), "size")
    over = placed.where(F.col("held") > limit)
    # the rows of such a shard are equal in all that is kept here but the id: counted, then numbered
    # salted by their number in the first written table, which no lost executor changes
    salt = F.pmod(F.col("_row"), F.lit(SALTS))
    counted = over.withColumn("salt", salt).groupBy("shard", "depth", "size", "id", "salt").agg(F.count("*").alias("n"))
    return fitting.union(_paged(counted, limit))


def write_shards(docs: DataFrame, key: Column, size: Column, tie: Column, path: str, limit: int = LIMIT) -> DataFrame:
    """Write ``docs`` with all columns as Parquet under ``path``/rows, one folder for each shard and page, and the directory under ``path``/directory, which is returned.

    The directory has a row for each shard: ``(shard, depth, pages, rows, bytes)``; :func:`locate` finds the shard of any row in it, new ones too. Each page is
    written by one task, so ``limit`` should be the size of a file that is worth reading. Columns may have any names but ``shard`` and ``page``; an empty table gives
    an empty directory and no rows.
    """
    if {c.lower() for c in docs.columns} & {"shard", "page"}:
        raise ValueError("the folders are named after the columns shard and page")
    # rows are told apart by their number, since ids may repeat
    inner = positional(docs.select("*", key.cast("string").alias("_key"), size.cast("long").alias("_size"), tie.cast("string").alias("_tie")).withColumn("_row", F.monotonically_increasing_id()))
    *own, by, held, tied, row = inner.columns
    stored = materialise(inner)
    placed = materialise(shard(stored, F.col(by), F.col(held), F.col(tied), row, limit))
    both = stored.join(placed.withColumnRenamed("id", row), row).select(*own, "shard", "page").toDF(*docs.columns, "shard", "page")
    both.repartition("shard", "page").write.partitionBy("shard", "page").parquet(f"{path.rstrip('/')}/rows")
    counted = placed.groupBy("shard", "depth").agg((F.max("page") + 1).alias("pages"), F.count("*").alias("rows"), F.sum("size").alias("bytes"))
    counted.write.parquet(f"{path.rstrip('/')}/directory")
    release(stored, placed)
    return docs.sparkSession.read.parquet(f"{path.rstrip('/')}/directory")


def locate(docs: DataFrame, directory: DataFrame, key: Column, tie: Column) -> DataFrame:
    """``docs`` with the ``shard`` that the directory holds for each row, the one it was written to or, for new rows, belongs to; NULL where no shard has its prefix yet.

    The prefixes of a row are looked up at the depths that occur, 120 at most; the directory is broadcast only if its measured size fits.
    """
    depths = sorted(r["depth"] for r in directory.select("depth").distinct().collect())
    names = docs.columns
    inner = positional(docs.select("*", F.concat(_bits(key), _bits(tie)).alias("_bits")).withColumn("_row", F.monotonically_increasing_id()))
    *own, bits, row = inner.columns
    stored = materialise(inner)
    tried = stored.select(row, F.explode(F.array(*[F.expr(f"substring({bits}, 1, {d})") for d in depths] or [F.lit(None).cast("string")])).alias("shard"))
    known, n = settle(directory.select("shard"))
    found = materialise(tried.join(lookup_side(known, n), "shard"))
    return stored.join(found, row, "left").select(*own, "shard").toDF(*names, *fresh(["shard"], names))


def _bits(value: Column) -> Column:
    return F.lpad(F.conv(hash_bits(value).cast("string"), 10, 2), BITS, "0")


def _paged(counted: DataFrame, limit: int) -> DataFrame:
    """Pages of shards whose rows share key and tie: numbers are dealt in the order of id within even id ranges."""
    counted = materialise(counted)
    ranged = materialise(counted.repartitionByRange("shard", "id", "salt").select("*", F.spark_partition_id().alias("_part")))
    held = ranged.groupBy("shard", "_part").agg(F.sum("n").alias("rows"), F.max("size").alias("most"))
    shard = Window.partitionBy("shard")
    before = held.select("shard", "_part", (F.sum("rows").over(shard.orderBy("_part")) - F.col("rows")).alias("_before"), F.max("most").over(shard).alias("_most"))
    within = F.sum("n").over(Window.partitionBy("shard", "_part").orderBy("id", "salt", "size")) - F.col("n")
    numbered = ranged.withColumn("_within", within).join(before, ["shard", "_part"])
    each = F.greatest(F.floor(F.lit(limit) / F.greatest(F.col("_most"), F.lit(1))), F.lit(1))
    return numbered.select("id", "shard", "depth", "size", F.explode(F.expr("sequence(_before + _within, _before + _within + n - 1)")).alias("_at"), each.alias("_each")).select(
        "id", "shard", "depth", F.floor(F.col("_at") / F.col("_each")).cast("long").alias("page"), "size"
    )
