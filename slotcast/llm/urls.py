"""URL filter: a blocked Bloom filter before an exact join. Only DataFrame functions."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotcast.session import materialise

#: Words of 64 bits in a block, and bits set for an entry.
BLOCK_WORDS = 8
PROBES = 6
#: Blocks at most: 64 MB of filter. Longer lists fill it more and let more false hits through to the join.
MOST_BLOCKS = 1 << 20
ENTRIES_PER_BLOCK = 32
#: A rule table up to this many bytes on disk is broadcast to the exact join.
BROADCAST_BYTES = 16 << 20
SALTS = 16


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: what is between the first ``://`` and ``/ ? #``, A-Z lower-cased, and from there to ``? #``. NULL and
    texts without ``://`` have empty ones."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """``(verdict, host, path)`` rows as a table."""
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def probes(entry: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block of an entry, and the numbers of its bits in the block."""
    block = F.pmod(F.shiftrightunsigned(F.xxhash64(entry), 20), F.lit(blocks)).cast("int")
    second = F.xxhash64(entry, F.lit(1))
    return block, [F.shiftrightunsigned(second, 9 * k).bitwiseAND(F.lit(BLOCK_WORDS * 64 - 1)).cast("int") for k in range(PROBES)]


def bloom(entries: DataFrame, blocks: int) -> DataFrame:
    """``(block, words)``: for each block that has entries its words of 64 bits."""
    block, bits = probes(F.col("entry"), blocks)
    each = entries.select(block.alias("block"), F.explode(F.array(*bits)).alias("bit"))
    masks = each.groupBy("block", F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, bit % 64)")).alias("mask"))
    words = [F.max(F.when(F.col("word") == w, F.col("mask"))) for w in range(BLOCK_WORDS)]
    return masks.groupBy("block").agg(F.array(*[F.coalesce(w, F.lit(0).cast("long")) for w in words]).alias("words"))


def possible(candidates: DataFrame, filter_: DataFrame, blocks: int) -> DataFrame:
    """The candidates (column ``entry``) whose bits are all set in their block. The filter is at most 64 MB, so it is broadcast."""
    block, bits = probes(F.col("entry"), blocks)
    probed = candidates.withColumn("block", block).withColumns({f"_bit{k}": b for k, b in enumerate(bits)}).join(F.broadcast(filter_), "block")
    for k in range(PROBES):
        probed = probed.where(F.expr(f"(element_at(words, cast(_bit{k} div 64 as int) + 1) & shiftleft(1L, _bit{k} % 64)) <> 0"))
    return probed.drop("block", "words", *[f"_bit{k}" for k in range(PROBES)])


def judge(pages: DataFrame, rules: DataFrame, url_column: str = "url", default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with all columns, and ``host``, ``path``, ``rule`` and ``verdict``; columns of these names in ``pages`` are replaced.

    A rule fits its host and all subdomains where the path starts with its path; the longest wins (the text ``host + path``), and
    of equal rules with different verdicts ``block``. Without one, ``rule`` is NULL and the verdict is ``default``. Rules with NULL parts
    or an empty host are ignored. Every page row gives one row, whatever repeats.

    Columns may have any names.

    Each distinct host makes the suffixes with as many labels as some rule has; those that a rule names go on with the starts of the path that have as many
    characters as a rule of that host. So the candidates of a url follow the rules of its own hosts, not the list. Blocked Bloom filters let listed hosts and
    entries through and few others, which exact joins remove.
    """
    host, path = parts(F.col(f"`{url_column}`"))
    listed = rules.where("host <> '' and path is not null and verdict is not null").groupBy(
        F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), "path"
    ).agg(F.max("verdict").alias("listed"))  # "block" is after "allow"
    listed = materialise(listed.select(F.concat("host", "path").alias("entry"), "listed", "host", _labels(F.col("host")).alias("labels"), F.length("path").alias("letters")))
    # as many lengths as a path has characters at most
    hosts = materialise(listed.groupBy(F.col("host").alias("entry"), "labels").agg(F.collect_set("letters").alias("lengths")))
    # bounded by the labels of a host, not by the number of rules
    labels = sorted(r["labels"] for r in hosts.select("labels").distinct().collect())
    names = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    own = [f"c{k}" for k in range(len(names))]
    split = pages.select(host.alias("host"), path.alias("path"), *[F.col(f"`{n}`").alias(c) for c, n in zip(own, names)])
    if not labels:
        return split.select(*own, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict")).toDF(*names, "host", "path", "rule", "verdict")
    seen = split.select("host", "path").distinct().where("host <> ''")
    suffixes = (
        seen.withColumn("labels", F.explode(F.array(*[F.lit(n) for n in labels]))).where(_labels(F.col("host")) >= F.col("labels"))
        .select("host", "path", F.expr("substring_index(host, '.', -labels)").alias("entry"), "labels")
    )
    known = _matched(suffixes, hosts, ["entry", "labels"], broadcast_bytes)
    starts = known.select("host", "path", F.col("entry").alias("named"), "labels", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("letters"))
    candidates = starts.select("host", "path", F.expr("concat(named, substring(path, 1, letters))").alias("entry"), "labels", "letters")
    exact = _matched(candidates, listed.drop("host"), ["entry", "labels", "letters"], broadcast_bytes)
    # written, so that a hot page can be split in the join
    verdicts = materialise(exact.groupBy(F.col("host").alias("_host"), F.col("path").alias("_path")).agg(F.max(F.struct(F.length("entry"), "entry", "listed")).alias("_best")))
    joined = split.join(verdicts, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    return joined.select(
        *own, "host", "path", F.col("_best.entry").alias("rule"), F.coalesce(F.col("_best.listed"), F.lit(default)).alias("verdict")
    ).toDF(*names, "host", "path", "rule", "verdict")


def _matched(candidates: DataFrame, listed: DataFrame, keys: list[str], broadcast_bytes: int) -> DataFrame:
    """Candidates joined with what is listed (a written table): through a Bloom filter of its entries, then exactly."""
    blocks = min(MOST_BLOCKS, max(1, math.ceil(listed.count() / ENTRIES_PER_BLOCK)))
    hits = possible(candidates, materialise(bloom(listed, blocks)), blocks)
    if _bytes(listed) <= broadcast_bytes:
        return hits.join(F.broadcast(listed), keys)
    salted = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return hits.withColumn("_salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"])


def _bytes(table: DataFrame) -> int:
    """Size of a written table as the optimizer knows it from its files."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
