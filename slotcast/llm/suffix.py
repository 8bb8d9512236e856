"""Repeated passages through a sparse suffix array over content-selected positions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotcast.llm.common import positional, ship, slices
from slotcast.llm.membership import told_apart
from slotcast.session import materialise, release, scratch

MIN_WORDS = 50
GRAM = 10
#: Suffixes and windows are equal if two hashes of 64 bits are: that of the gram, and that of all words.
KIND = ["seed", "span"]
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for at least ``n`` positions."""
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 2 * len(_powers), 1 << 16)
        steps = [np.full(n, b, dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        for s in steps:
            s[0] = 1
        _powers, _inverses = (np.multiply.accumulate(s) for s in steps)
    return _powers, _inverses


class Rolling:
    """Hashes of any word range of a text in constant time."""

    def __init__(self, text: bytes) -> None:
        words = text.split()
        self.n = len(words)
        codes = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(7)), dtype=np.uint64, count=self.n)
        powers, self.inverses = _tables(self.n + 1)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(codes * powers[: self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Mixed hashes of the ranges of ``length`` words at ``start``."""
        h = (self.sums[start + length] - self.sums[start]) * self.inverses[start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def minimisers(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of every ``width`` neighbouring values, the leftmost of equal ones."""
    low, at, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = low[:-step], low[step:]
        first = left <= right
        low, at = np.where(first, left, right), np.where(first, at[:-step], at[step:])
        span += step
    return at


def anchored(text: bytes, min_words: int, gram: int) -> tuple[np.ndarray, ...] | None:
    """The suffixes retained of a text: first window, number of windows, hash of the gram at the position, hash of all
    words that the windows cover. Windows of ``min_words`` words belong to the position of their smallest gram."""
    words = Rolling(text)
    windows = words.n - min_words + 1
    if windows < 1:
        return None
    grams = words.of(np.arange(words.n - gram + 1), gram)
    position = minimisers(grams, min_words - gram + 1)
    first = np.flatnonzero(np.append(True, position[1:] != position[:-1]))
    count = np.diff(np.append(first, windows))
    span = words.of(first, count + (min_words - 1)) ^ (count.astype(np.uint64) * np.uint64(_BASE))
    return first, count, grams[position[first]], span


def _anchors(min_words: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found, take = [], []
            for row, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                if text and (a := anchored(text, min_words, gram)) is not None:
                    found.append(a)
                    take.append(np.full(len(a[0]), row))
            if found:
                start, count, seed, span = (np.concatenate(c) for c in zip(*found))
                row = pa.array(np.concatenate(take))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(row), batch.column("version").take(row), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)),
                     pa.array(seed.view(np.int64)), pa.array(span.view(np.int64))],
                    ["id", "version", "start", "count", "seed", "span"],
                )

    return step


def _windows(min_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = []
            for text, wanted in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("wanted").to_pylist()):
                words = Rolling(text)
                start, count = (np.array([w[k] for w in wanted]) for k in ("start", "count"))
                seed, span = (np.repeat(np.array([w[k] for w in wanted], dtype=np.int64), count) for k in ("seed", "span"))
                step_ = np.arange(len(span)) - np.repeat(np.cumsum(count) - count, count)
                found.append((seed, span, step_.astype(np.int32), words.of(np.repeat(start, count) + step_, min_words).view(np.int64)))
                if sum(len(f[0]) for f in found) > 1 << 17:
                    yield _window_batch(found)
                    found = []
            if found:
                yield _window_batch(found)

    return step


def _window_batch(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["seed", "span", "step", "window"])


def _version(text_column: str) -> Column:
    """Tells texts of one id apart, by 64 bits."""
    return F.xxhash64(F.col(f"`{text_column}`"), F.lit(1))


def repeated_passages(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS, gram: int = GRAM
) -> DataFrame:
    """Every occurrence of a passage of at least ``min_words`` words that occurs more than once.

    Returns ``(id, version, start, n_words, first_id, first_start, kept)``: word range, the first occurrence in the order of
    id, and whether this is it. Each word range of ``min_words`` words with an equal elsewhere, in another
    document or the same, is inside such a passage, and no other is; neighbouring ranges with the same source are one
    passage. Words end at ASCII white space and count case. ``version`` is a hash of the text: rows with equal
    id and text are one document, rows that share only the id are two. NULL and shorter texts have no passages;
    a NULL id orders first.

    Positions with the smallest gram hash of a window are retained, about one in 20. Suffixes are brought together by
    the gram they start with, then by all words around them; equal neighbours are counted before the shuffle. Only where
    suffixes of one gram differ, the match is extended word by word to the left and right, once for each distinct surrounding.
    """
    if not 1 <= gram <= min_words:
        raise ValueError("gram must be between 1 and min_words")
    ship(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    texts = docs.select(F.col(f"`{id_column}`").alias("id"), _version(text_column).alias("version"), F.col(f"`{text_column}`").alias("text")).where("text is not null")
    kept = materialise(texts.mapInArrow(_anchors(min_words, gram), f"id {kind}, version long, start int, count int, seed long, span long"))
    # a gram that occurs at one place has no partner; counts are written, so that Spark can split a hot gram in the join
    shared = materialise(kept.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed"))
    # written before rows are made distinct: else both would share one shuffle by gram, which can not be split
    joined = materialise(kept.join(shared, "seed", "left_semi"))
    members = materialise(joined.distinct())
    release(kept, shared, joined)
    spans = materialise(
        members.groupBy("seed", "span").agg(F.count("*").alias("n"), F.min(F.struct("id", "start", "version", "count")).alias("first"))
    )
    mixed = materialise(spans.groupBy("seed").agg(F.count("*").alias("kinds")).where("kinds > 1").select("seed"))
    # extend only where surroundings differ; the first member stands for its kind
    differing = materialise(spans.join(mixed, "seed", "left_semi"))
    wanted = differing.groupBy(F.col("first.id").alias("id"), F.col("first.version").alias("version")).agg(
        F.collect_list(F.struct("seed", "span", F.col("first.start").alias("start"), F.col("first.count").alias("count"))).alias("wanted")
    )
    near = texts.join(wanted.select(F.col("id").alias("_id"), F.col("version").alias("_version"), "wanted"), F.expr("id <=> _id and version = _version"))
    windows = materialise(
        near.dropDuplicates(["id", "version"]).select("text", "wanted").mapInArrow(_windows(min_words), "seed long, span long, step int, window long")
        .join(differing.select(*KIND, "n", "first"), KIND)
        .select(*KIND, "step", "window", "n", F.struct(F.col("first.id").alias("id"), (F.col("first.start") + F.col("step")).alias("start")).alias("source"))
    )
    sources = materialise(windows.groupBy("seed", "window").agg(F.sum("n").alias("n"), F.min("source").alias("source")).where("n > 1").drop("n"))
    extended = windows.select(*KIND, "step", "window").join(sources, ["seed", "window"]).select(*KIND, "step", "source", F.lit(1).alias("length"))
    whole = (
        spans.where("n > 1").join(mixed, "seed", "left_anti")
        .select(*KIND, F.lit(0).alias("step"), F.struct(F.col("first.id").alias("id"), F.col("first.start").alias("start")).alias("source"), F.col("first.count").alias("length"))
    )
    pieces = _merged(extended, KIND, "step", "length", "source").union(whole.select(*KIND, "step", "length", "source"))
    placed = members.select("id", "version", "start", *KIND).join(pieces, KIND).select(
        "id", "version", (F.col("start") + F.col("step")).alias("start"), "length", "source"
    )
    passages = _merged(placed, ["id", "version"], "start", "length", "source")
    return passages.select(
        "id", "version", "start", (F.col("length") + F.lit(min_words - 1)).cast("int").alias("n_words"), F.col("source.id").alias("first_id"), F.col("source.start").alias("first_start"),
        F.expr("id <=> source.id and start = source.start").alias("kept"),
    )


def _merged(rows: DataFrame, keys: list[str], start: str, length: str, source: str) -> DataFrame:
    """Join ranges of windows that follow each other in a key and come from windows that follow each other.

    A key is a document or a suffix: its rows are bounded by one text.
    """
    order = Window.partitionBy(*keys).orderBy(start)
    shift = F.col(f"{source}.start") - F.col(start)
    follows = (
        F.lag(F.col(start) + F.col(length)).over(order).eqNullSafe(F.col(start))
        & F.lag(f"{source}.id").over(order).eqNullSafe(F.col(f"{source}.id"))
        & F.lag(shift).over(order).eqNullSafe(shift)
    )
    marked = rows.withColumn("_fresh", (~follows).cast("int")).withColumn("_run", F.sum("_fresh").over(order))
    return marked.groupBy(*keys, "_run").agg(F.min(start).alias(start), F.sum(length).alias(length), F.min(source).alias(source)).select(*keys, start, length, source)


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_text"):
        texts = [cut(t, c) for t, c in zip(batch.column("_text").to_pylist(), batch.column("_cuts").to_pylist())]
        at = batch.schema.get_field_index("_text")
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.string()))


def cut(text: str | None, passages: list[dict] | None) -> str | None:
    """Take out the words of repeated passages, each with the white space after it, unless a first occurrence holds them."""
    if text is None or not passages:
        return text
    raw = text.encode()
    words = raw.split()
    gone = np.zeros(len(words) + 1, dtype=bool)
    for kept in (False, True):
        for p in passages:
            if p["kept"] == kept:
                gone[p["start"] : p["start"] + p["n_words"]] = not kept
    if not gone.any():
        return text
    space = np.isin(np.frombuffer(raw, np.uint8), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
    begin = np.flatnonzero(~space & np.append(True, space[:-1]))
    edge = np.concatenate([[0], begin[1:], [len(raw)]]) if len(begin) else np.array([0, len(raw)])
    return b"".join(raw[a:b] for a, b, g in zip(edge[:-1], edge[1:], gone) if not g).decode()


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """``docs`` with all columns, the texts without the later occurrences of repeated passages.

    A word that belongs to the first occurrence of any passage stays. A document none of whose words stay
    is left out; texts that had no words before stay as they are. Columns may have any names.
    """
    names = docs.columns
    inner = positional(docs)
    place = dict(zip(names, inner.columns))
    id_column, text_column = place[id_column], place[text_column]
    with scratch() as made:
        found = repeated_passages(inner, id_column, text_column, min_words, gram)
    cuts = found.groupBy(F.col("id").alias("_id"), F.col("version").alias("_version")).agg(
        F.max(~F.col("kept")).alias("_some"), F.collect_list(F.struct("start", "n_words", "kept")).alias("_cuts")
    ).where("_some").drop("_some")
    # stored, so that the tables of suffixes can go before texts are joined
    cuts = materialise(cuts)
    release(*made)
    # texts without a cut are most, and are not shuffled
    listed, others = told_apart(inner.withColumn("_v", _version(text_column)), F.col("_v"), cuts.select("_version"))
    joined = listed.join(cuts, F.col(id_column).eqNullSafe(F.col("_id")) & (F.col("_v") == F.col("_version")), "left")
    rows = joined.select(*[c for c in inner.columns if c != text_column], F.col(text_column).alias("_text"), "_cuts")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    done = rows.mapInArrow(_cutter, schema)
    stay = done.where("_cuts is null or length(trim(_text)) > 0").withColumnRenamed("_text", text_column)
    return stay.select(*inner.columns).union(others.select(*inner.columns)).toDF(*names)
