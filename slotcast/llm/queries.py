"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotcast.llm import embeddings, langid, linerules, neighbours, packing, periods, pieces, quality, sharding, simhash, suffix, urls, vectorcodes
from slotcast.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

#: Verdict, host and path of each rule.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    placed = sharding.shard(docs, F.col("doc_id"), F.octet_length("text"), F.col("text"))
    return placed.select(F.col("id").alias("doc_id"), "shard", "depth", "page", F.col("size").alias("n_bytes"))


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return urls.judge(pages, urls.rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    vocabulary = pieces.Vocabulary.read(public_tokenizers.path("piece_bpe_32k.model"))
    coded = pieces.encode(table(spark, folder, "documents"), vocabulary)
    digest = coded.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("ids_sha256", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256))
    back = pieces.decode(digest, vocabulary)
    return back.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op4_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = embeddings.near_duplicates(table(spark, folder, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix.repeated_passages(table(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("start").alias("start_word"), "n_words", F.col("first_id").alias("first_doc_id"), F.col("first_start").alias("first_start_word"), "kept"
    )


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.sampled_out("doc_id"))
    model = langid.fit(docs.where("not held_out"))
    found = langid.predict(docs, model, carry=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"))


def op8_nearest(spark: SparkSession, folder: str) -> DataFrame:
    found = neighbours.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    stats = quality.materialise(quality.measured(table(spark, folder, "documents"), carry=["doc_id"]))
    model = quality.fit(quality.training_rows(stats, table(spark, folder, "labels")))
    held_out = F.coalesce(quality.checksum("doc_id") % 5 == 0, F.lit(False))
    return quality.scored(stats, model).select(
        "doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= quality.ACCEPT).cast("int").alias("predicted")
    )


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Byte-level tokens and an end mark for each document."""
    placed = packing.pack(table(spark, folder, "documents"), F.coalesce(F.octet_length("text"), F.lit(0)) + 1)
    return placed.select(F.col("id").alias("doc_id"), "piece", "start", "n_tokens", "bin", "position", "offset", "capacity")


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of the documents, by checksum of the id, has its tail replaced by repeats of a few of its words before runs are sought."""
    h = quality.checksum("doc_id")
    words = F.expr("filter(split(text, '[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+'), w -> w <> '')")
    docs = table(spark, folder, "documents").select("doc_id", "text", h.alias("h"))
    hit = (F.col("h") % 10 == 0) & (F.size("words") > 0)
    cut = docs.withColumn("words", F.when(F.col("h") % 10 == 0, words)).select("doc_id", "text", "words", hit.alias("hit"), F.size("words").cast("long").alias("n"), F.expr("h div 10").alias("g"))
    tail = cut.withColumn("a", F.when(F.col("hit"), F.expr("g % n"))).withColumn("p", F.when(F.col("hit"), F.expr("1 + (n - a) div (3 + g % 8)")))
    looped = F.expr(
        "array_join(concat(slice(words, 1, int(a)), slice(flatten(array_repeat(slice(words, int(a) + 1, int(p)), int((n - a + p - 1) div p))), 1, int(n - a))), ' ')"
    )
    found = periods.periodic_runs(tail.select("doc_id", F.when(F.col("hit"), looped).otherwise(F.col("text")).alias("text")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = F.col("strongest")
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return linerules.judge(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id").drop("cleaned")


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = vectorcodes.compress(table(spark, folder, "embeddings"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


def registered() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_sharding, op2_url_filter, op3_sentencepiece, op4_embedding_dedup, op5_simhash, op6_suffix_dedup, op7_language, op8_nearest, op9_quality, op10_packing,
        op11_periodic_runs, op12_quality_rules, op13_vector_codes,
    )}
