"""Rows that a much shorter list may name, told from all others without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotcast.llm.urls import ENTRIES_PER_BLOCK, MOST_BLOCKS, bloom, probes
from slotcast.session import materialise


def told_apart(rows: DataFrame, key: Column, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose ``key`` may be in ``named`` (a written table of one column of the key's type), and those whose key is not.

    All rows that are named are among the former, with few others, which an exact join has to tell; so only these need a shuffle. The list
    goes into a blocked Bloom filter of 64 MB at most, which is broadcast. Each side reads ``rows`` again.
    """
    entries = named.toDF("entry")
    blocks = min(MOST_BLOCKS, max(1, -(-named.count() // ENTRIES_PER_BLOCK)))
    filter_ = materialise(bloom(entries, blocks)).toDF("_block", "_words")
    block, bits = probes(key, blocks)
    probed = rows.withColumn("_block", block).join(F.broadcast(filter_), "_block", "left")
    hit = F.col("_words").isNotNull()
    for bit in bits:
        word = F.element_at("_words", F.floor(bit / 64).cast("int") + 1)
        hit = hit & (F.getbit(word, bit % 64) == 1)
    marked = probed.withColumn("_hit", F.coalesce(hit, F.lit(False))).drop("_block", "_words")
    return marked.where("_hit").drop("_hit"), marked.where("not _hit").drop("_hit")
