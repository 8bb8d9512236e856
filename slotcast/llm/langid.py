"""Language identification: averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotcast.llm.common import carried, fresh, positional, put_back, ship, slices
from slotcast.session import materialise, release

BUCKETS = 1 << 13
DIMENSIONS = 16
#: Bounds of the training sample, which reaches the driver as bucket counts: different rows per language and in all, in expectation, and languages.
ROWS_PER_LANGUAGE = 800
MOST_ROWS = 16_000
MOST_LANGUAGES = 256
UNKNOWN = "und"
#: No text is rejected whose most likely language has at least this calibrated probability.
CEILING = 0.4
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once in a worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def subwords(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Hash buckets of all one to three letter sequences of the words of a text, with word ends."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = letters()[code]
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    seen = letter | np.append(False, letter[:-1])
    code = np.concatenate([[0], np.where(letter, code, 0)[seen], [0]]).astype(np.uint64)
    inner = code > 0
    one = code[inner] * np.uint64(0x9E3779B97F4A7C15)
    two = (code[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + code[1:]) * np.uint64(0x165667B19E3779F9)
    two = two[inner[:-1] | inner[1:]]
    three = ((code[:-2] * np.uint64(0x85EBCA77C2B2AE63) + code[1:-1]) * np.uint64(0x27D4EB2F165667C5) + code[2:]) * np.uint64(0xD6E8FEB86659FD93)
    three = three[inner[1:-1]]
    return (np.concatenate([one, two, three]) >> np.uint64(40)).astype(np.int64) % buckets


#: How far beyond the held-back rows of the known languages a text may be from its language's usual subwords.
SLACK = 1.25
#: Share of subwords that the usual distribution of a language leaves to ones it has not seen.
UNSEEN = 0.02


@dataclass(frozen=True)
class LanguageModel:
    """Embeddings times output weights, one row per bucket; temperature and thresholds come from held-back rows.

    A softmax is confident on texts of no learned language too, so each language also knows how usual each bucket is in it (``usual``: logarithm of the
    share over an even one), with mean and deviation over its own subwords.
    """

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    usual: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    farthest: float

    def strangeness(self, means: np.ndarray, counts: np.ndarray, language: np.ndarray) -> np.ndarray:
        """Deviations by which texts of so many subwords are less usual in their language than its own texts."""
        own = np.einsum("ij,ji->i", means, self.usual[:, language])
        return (self.centre[language] - own) * np.sqrt(counts) / self.spread[language]

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of rows of averaged bucket counts."""
        return softmax((means @ self.table + self.bias) / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = [np.unique(subwords(t or ""), return_counts=True) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array([b.astype(np.int32) for b, _ in found], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32()))],
            ["lang", "bucket", "count"],
        )


def fit(labelled: DataFrame, text_column: str = "text", lang_column: str = "lang", rows: int = ROWS_PER_LANGUAGE, seed: int = 7, target: float = 0.999) -> LanguageModel | None:
    """Train on a hash sample of about ``rows`` different rows per language (all different rows of rarer ones, ``MOST_ROWS`` in all); whole texts are
    counted by tasks.

    Shares follow the different texts of a language, so neither copies nor the size of the table change how many are learned from. Of more than
    ``MOST_LANGUAGES`` values of the language column those with most different texts are learned. Stochastic gradient descent runs on the bounded sample. A fifth
    is held back: the temperature minimises its log loss, and the thresholds keep the share ``target`` of its rows: the highest probability up to ``CEILING``, and
    ``SLACK`` times the distance from a language's usual subwords. NULL
    languages and texts without letters are no training rows; without any row there is no model.
    """
    ship(labelled.sparkSession)
    pairs = labelled.select(F.col(f"`{text_column}`").alias("text"), F.col(f"`{lang_column}`").cast("string").alias("lang")).where("lang is not null and text is not null")
    place = F.xxhash64("text", F.lit(seed))
    # texts are told apart by 64 bits: a chance collision only moves a share a little
    texts = pairs.select("lang", place.alias("place")).distinct().groupBy("lang").agg(F.count("*").alias("n"))
    known = materialise(texts.orderBy(F.col("n").desc(), "lang").limit(MOST_LANGUAGES))
    languages = known.count()
    if not languages:
        return None
    wanted = min(float(rows), MOST_ROWS / languages)
    rates = known.select("lang", F.least(F.lit(1.0), F.lit(wanted) / F.col("n")).alias("rate"))
    # copies share a place: a hot text is one row of the sample
    drawn = pairs.join(F.broadcast(rates), "lang").where(F.pmod(place, F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.col("rate"))
    sample = drawn.select("text", "lang").distinct().mapInArrow(_counter, "lang string, bucket array<int>, count array<int>").toArrow()
    release(known)
    buckets, counts, names = sample.column("bucket").to_pylist(), sample.column("count").to_pylist(), sample.column("lang").to_pylist()
    order = sorted((i for i in range(len(names)) if buckets[i]), key=lambda i: (names[i], buckets[i], counts[i]))
    if not order:
        return None
    learned = tuple(sorted({names[i] for i in order}))
    x = [(np.array(buckets[i]), np.array(counts[i], dtype=np.float32) / sum(counts[i])) for i in order]
    y = np.array([learned.index(names[i]) for i in order])
    return train(x, y, learned, seed, target, sizes=np.array([sum(counts[i]) for i in order]))


def dense(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    for k, (b, v) in enumerate(rows):
        out[k, b] = v
    return out


def train(
    x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, languages: tuple[str, ...], seed: int, target: float, epochs: int = 12, batch: int = 32, sizes: np.ndarray | None = None
) -> LanguageModel:
    """``x`` has the buckets of each row and their shares, ``sizes`` its number of subwords."""
    random = np.random.default_rng(seed)
    order = random.permutation(len(y))
    held = order[: len(y) // 5]
    used = order[len(held):]
    weight = 1 / np.maximum(1, np.bincount(y[used], minlength=len(languages)))
    weight *= len(used) / max(1, (weight > 0).sum())
    embed = random.normal(0, 0.3, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out = random.normal(0, 0.3, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    for epoch in range(epochs):
        rate = 4.0 * (1 - epoch / epochs)
        used = random.permutation(used)
        for start in range(0, len(used), batch):
            at = used[start : start + batch]
            rows = dense([x[i] for i in at])
            hidden = rows @ embed
            grad = softmax(hidden @ out + bias)
            grad[np.arange(len(at)), y[at]] -= 1
            grad *= (weight[y[at]] / len(at))[:, None]
            back = grad @ out.T
            out -= np.float32(rate) * (hidden.T @ grad)
            bias -= np.float32(rate * 0.1) * grad.sum(axis=0)
            touched = np.unique(np.concatenate([x[i][0] for i in at]))
            # a subword is a small part of a text's mean, so its step is longer
            embed[touched] -= np.float32(rate * 20) * (rows[:, touched].T @ back)
    table = embed @ out
    logits = np.concatenate([dense([x[i] for i in held[k : k + 256]]) @ table + bias for k in range(0, len(held), 256)]) if len(held) else np.zeros((0, len(languages)))
    grid = np.geomspace(0.25, 8, 41)
    loss = [-np.log(softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean() if len(held) else abs(t - 1) for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    top = softmax(logits / temperature).max(axis=1) if len(held) else np.zeros(0)
    threshold = min(CEILING, float(np.quantile(top, 1 - target))) if len(top) else 0.0
    share = np.full((BUCKETS, len(languages)), UNSEEN / BUCKETS)
    rows_of = np.bincount(y[used], minlength=len(languages))
    for i in used:
        share[x[i][0], y[i]] += (1 - UNSEEN) * x[i][1] / rows_of[y[i]]
    usual = np.log(share * BUCKETS)
    centre = (share * usual).sum(axis=0)
    spread = np.sqrt(np.maximum((share * usual * usual).sum(axis=0) - centre * centre, 1e-6))
    model = LanguageModel(languages, table.astype(np.float32), bias, temperature, threshold, usual, centre, spread, np.inf)
    if sizes is None or not len(held):
        return model
    best = np.argmax(logits, axis=1)
    far = np.array([float(model.strangeness(dense([x[i]]).astype(float), sizes[[i]], best[[k]])[0]) for k, i in enumerate(held)])
    return replace(model, farthest=max(SLACK * float(np.quantile(far, target)), 1.0))


def _predictor(model: LanguageModel | None, text: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            texts = batch.column("_text").to_pylist()
            lang, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
            for start in range(0, len(texts), 128):
                part = texts[start : start + 128]
                means, sizes, good = np.zeros((len(part), BUCKETS), dtype=np.float32), np.zeros(len(part)), []
                for k, t in enumerate(part):
                    found = subwords(t) if t else ()
                    if len(found):
                        means[k] = np.bincount(found, minlength=BUCKETS) / len(found)
                        sizes[k] = len(found)
                        good.append(k)
                if model is None:
                    rejected[[start + k for k in good]] = False
                    continue
                p = model.probabilities(means)
                strange = model.strangeness(means, sizes, p.argmax(axis=1))
                for k in good:
                    lang[start + k], score[start + k] = model.languages[int(p[k].argmax())], float(p[k].max())
                    rejected[start + k] = score[start + k] < model.threshold or strange[k] > model.farthest
            yield pa.RecordBatch.from_arrays([*put_back(batch, text, names), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*names, "_lang", "_score", "_rejected"])

    return step


def _flagged(docs: DataFrame, model: LanguageModel | None, text_column: str) -> DataFrame:
    """Columns named by position, then ``_lang``, ``_score`` and ``_rejected``."""
    ship(docs.sparkSession)
    inner = positional(docs)
    text = inner.columns[docs.columns.index(text_column)]
    rows, schema = carried(inner, text, inner.columns)
    return rows.mapInArrow(_predictor(model, text, inner.columns), f"{schema}, _lang string, _score double, _rejected boolean")


def predict(docs: DataFrame, model: LanguageModel | None, text_column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of every row, with ``_lang``, ``_score`` (calibrated probability, 0 to 1) and ``_rejected``. A name that ``docs`` has
    already gets further underscores in front.

    NULL, and texts without a letter, are ``und`` with score 0 and rejected. A score below the model's threshold is
    rejected too, and a text whose subwords are less usual in its language than those of any known text by a calibrated margin. Without a model every row is ``und`` with score 0, and only texts without a letter are rejected.
    Only the text is used, and all of it. Columns may have any names.
    """
    names = carry if carry is not None else docs.columns
    flagged = _flagged(docs, model, text_column)
    own = [flagged.columns[docs.columns.index(n)] for n in names]
    return flagged.select(*own, "_lang", "_score", "_rejected").toDF(*names, *fresh(["_lang", "_score", "_rejected"], names))


def accepted(docs: DataFrame, model: LanguageModel | None, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`predict` does not reject, with all columns, whatever their names."""
    flagged = _flagged(docs, model, text_column)
    return flagged.where("not _rejected").select(*flagged.columns[:-3]).toDF(*docs.columns)


def sampled_out(id_column: str) -> Column:
    """Rows kept out of training: a quarter, by checksum of the id as text."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))
