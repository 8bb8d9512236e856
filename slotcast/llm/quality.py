"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotcast.llm.common import carried, fresh, positional, put_back, ship, slices
from slotcast.session import materialise

FEATURES = 256
FOLDS = 4
#: Documents with at least this score are accepted.
ACCEPT = 0.3
BINS = 2048
#: Partitions whose sums are brought together.
PARTS = 256
_KIND = np.full(256, 6, dtype=np.uint8)  # 0 lower, 1 upper, 2 digit, 3 blank, 4 line end, 5 plain punctuation, 6 sign, 7 beyond ASCII
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[[9, 11, 12, 13, 32]] = 3
_KIND[10] = 4
_KIND[[ord(c) for c in ".,;:'\"-()?"]] = 5
_KIND[128:] = 7
_PLAIN = np.where(np.isin(np.arange(256), [ord(c) for c in "!#$%&*|@<>=_~^/\\{}[]+"]), 1, 0).astype(np.uint8)
STATISTICS = 20


def statistics(raw: bytes) -> np.ndarray:
    """Numbers that describe a text of any length, the empty one included."""
    out = np.zeros(STATISTICS)
    b = np.frombuffer(raw, dtype=np.uint8)
    n = len(b)
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    w, m = len(words), len(lines)
    out[0], out[1], out[2] = np.log1p(n), np.log1p(w), np.log1p(m)
    if not w:
        return out
    share = np.bincount(_KIND[b], minlength=8) / n
    out[3:11] = share
    used = np.bincount(b, minlength=256) / n
    used = used[used > 0]
    out[11] = -(used * np.log2(used)).sum()
    distinct = len(set(words))
    out[12] = np.log1p(distinct) - np.log1p(w) * 0.8
    out[13] = distinct / w
    out[14] = sum(map(eq, words[1:], words)) / w
    out[15] = (n - share[3] * n - share[4] * n) / w
    out[16] = len(set(lines)) / m
    out[17] = np.log1p(n / m)
    signs = _PLAIN[b]
    out[18] = signs.sum() / w
    upper, letter = share[1], share[0] + share[1]
    out[19] = upper / letter if letter else 0.0
    return out


def _measured(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t or b"") for t in texts.cast(pa.binary()).to_pylist()], dtype=np.float32).reshape(-1, STATISTICS)


def _measure(text: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            values = pa.array(list(_measured(batch.column("_text"))), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*put_back(batch, text, names), values], [*names, "_stats"])

    return step


def measured(docs: DataFrame, text_column: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` and ``_stats``, the statistics of the whole text; NULL counts as empty."""
    ship(docs.sparkSession)
    names = carry if carry is not None else docs.columns
    rows, schema = carried(docs, text_column, names)
    return rows.mapInArrow(_measure(text_column, names), f"{schema}, _stats array<float>")


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    deviation: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    level: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Cosines whose products approximate a Gaussian kernel, and a constant."""
        x = np.clip((stats - self.mean) / self.deviation, -8, 8)
        z = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / self.directions.shape[1])
        return np.hstack([z, np.ones((len(z), 1))])

    def scores(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated scores; a thousandth part keeps the order of the raw scores inside level stretches."""
        raw = self.features(stats) @ self.weights
        order = 1 / (1 + np.exp(-4 * (np.clip(raw, -3, 4) - 0.5)))
        return np.clip(0.999 * np.interp(raw, self.at, self.level) + 0.001 * order, 0, 1)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, STATISTICS)


def _sums(model: QualityModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Normal equations of a partition, for each fold: rows of z'z with z'y as the last entry."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = model.directions.shape[1] + 1
        total = np.zeros((FOLDS, d, d + 1))
        seen = False
        for batch in batches:
            stats, label, fold = _matrix(batch.column("_stats")), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            for start in range(0, len(stats), 2048):
                z = model.features(stats[start : start + 2048])
                for f in range(FOLDS):
                    own = fold[start : start + 2048] == f
                    if own.any():
                        seen = True
                        total[f] += z[own].T @ np.hstack([z[own], label[start : start + 2048][own][:, None]])
        if seen:
            for f in range(FOLDS):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array(list(total[f]), pa.list_(pa.float64()))], ["fold", "i", "row"]
                )

    return step


def _raw(model: QualityModel, weights: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats, fold = _matrix(batch.column("_stats")), batch.column("fold").to_numpy()
            raw = (model.features(stats) * weights[fold]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(raw)], ["label", "raw"])

    return step


def pool(at: np.ndarray, mean: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling neighbours that are out of order; the blocks' places and levels."""
    blocks: list[list[float]] = []
    for a, m, w in zip(at, mean, weight):
        blocks.append([a, m, w])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            a2, m2, w2 = blocks.pop()
            a1, m1, w1 = blocks.pop()
            blocks.append([(a1 * w1 + a2 * w2) / (w1 + w2), (m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2])
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def fit(train: DataFrame, seed: int = 11, ridge: float = 1e-4, width: float = 1.0) -> QualityModel | None:
    """Fit on all rows of ``train`` (``_stats``, ``label`` 0 or 1, ``fold`` 0 to 3); None without rows.

    Tasks add up normal equations over their rows, Spark adds the partitions' sums; the driver solves one small
    system for each fold left out and one for all. Scores of left-out folds, counted in bins, are calibrated
    by isotonic regression, so the calibration has not seen its own labels.
    """
    ship(train.sparkSession)
    stats = [F.col("_stats")[k].cast("double") for k in range(STATISTICS)]
    row = train.agg(F.count("*").alias("n"), *[F.avg(s).alias(f"m{k}") for k, s in enumerate(stats)], *[F.stddev_pop(s).alias(f"d{k}") for k, s in enumerate(stats)]).first()
    if not row["n"]:
        return None
    mean = np.array([row[f"m{k}"] for k in range(STATISTICS)])
    deviation = np.array([row[f"d{k}"] for k in range(STATISTICS)])
    deviation[deviation < 1e-9] = 1.0
    random = np.random.default_rng(seed)
    directions = random.normal(0, 1 / (width * np.sqrt(STATISTICS)), (STATISTICS, FEATURES))
    empty = np.zeros(0)
    model = QualityModel(mean, deviation, directions, random.uniform(0, 2 * np.pi, FEATURES), empty, empty, empty)
    d = FEATURES + 1
    sums = np.zeros((FOLDS, d, d + 1))
    parts = train.coalesce(PARTS).mapInArrow(_sums(model), "fold int, i int, row array<double>")
    added = parts.select("fold", "i", F.posexplode("row").alias("j", "v")).groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))
    got = added.toArrow()  # FOLDS squares, whatever the input
    sums[got.column("fold").to_numpy(), got.column("i").to_numpy(), got.column("j").to_numpy()] = got.column("v").to_numpy()
    total = sums.sum(axis=0)

    def solve(s: np.ndarray) -> np.ndarray:
        n = max(s[-1, d - 1], 1.0)
        return np.linalg.solve(s[:, :d] + ridge * n / FEATURES * np.eye(d), s[:, d])

    left_out = np.array([solve(total - sums[f]) for f in range(FOLDS)])
    scored = train.mapInArrow(_raw(model, left_out), "label int, raw double")
    low, high = -0.5, 1.5
    place = F.least(F.greatest(F.floor((F.col("raw") - low) / (high - low) * BINS), F.lit(0)), F.lit(BINS - 1))
    bins = scored.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg("label").alias("mean"), F.avg("raw").alias("at")).collect()  # BINS rows at most
    bins.sort(key=lambda r: r["bin"])
    at, level = pool(*(np.array([float(r[c]) for r in bins]) for c in ("at", "mean", "n")))
    return QualityModel(mean, deviation, directions, model.phases, solve(total), at, level)


def _scorer(model: QualityModel | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = _matrix(batch.column("_stats"))
            score = np.concatenate([model.scores(stats[k : k + 2048]) for k in range(0, len(stats), 2048)]) if model and len(stats) else np.full(len(stats), 0.5)
            keep = [n for n in batch.schema.names if n != "_stats"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(score)], [*keep, "_score"])

    return step


def scored(stats: DataFrame, model: QualityModel | None) -> DataFrame:
    """The rows of ``measured`` with ``_score`` in place of the statistics; 0.5 everywhere without a model."""
    fields = [f for f in stats.schema.fields if f.name != "_stats"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "_score double"])
    return stats.mapInArrow(_scorer(model), schema)


def _judge(model: QualityModel | None, text: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            score = model.scores(_measured(batch.column("_text")).astype(np.float64)) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*put_back(batch, text, names), pa.array(score)], [*names, "_score"])

    return step


def _flagged(docs: DataFrame, model: QualityModel | None, text_column: str) -> DataFrame:
    """Columns named by position, then ``_score``."""
    ship(docs.sparkSession)
    inner = positional(docs)
    text = inner.columns[docs.columns.index(text_column)]
    rows, schema = carried(inner, text, inner.columns)
    return rows.mapInArrow(_judge(model, text, inner.columns), f"{schema}, _score double")


def judged(docs: DataFrame, model: QualityModel | None, text_column: str = "text") -> DataFrame:
    """``docs`` with ``_score``, measured and scored in one pass; 0.5 everywhere without a model. Columns may have any names; if there is
    a ``_score``, the added one gets further underscores in front."""
    return _flagged(docs, model, text_column).toDF(*docs.columns, *fresh(["_score"], docs.columns))


def accepted(docs: DataFrame, model: QualityModel | None, least: float = ACCEPT, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of ``least`` and more, with all columns, whatever their names."""
    flagged = _flagged(docs, model, text_column)
    return flagged.where(F.col("_score") >= least).select(*flagged.columns[:-1]).toDF(*docs.columns)


def checksum(id_column: str) -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary"))


def training_rows(stats: DataFrame, labels: DataFrame, id_column: str = "doc_id", label_column: str = "quality", left_out: int | None = 0) -> DataFrame:
    """Statistics with labels and folds, without the rows whose checksum modulo 5 is ``left_out`` (none, if that is None). Several
    labels of an id count as their largest; rows without id or label are no training rows."""
    known = labels.where(F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("_key")).agg(F.max(label_column).cast("int").alias("label"))
    rest = checksum(id_column) % 5
    used = F.col(id_column).isNotNull() if left_out is None else F.col(id_column).isNotNull() & (rest != left_out)
    fold = F.pmod(F.xxhash64(id_column), F.lit(FOLDS)).cast("int")
    rows = stats.where(used).select(F.col(id_column).alias("_id"), "_stats", fold.alias("fold"))
    return materialise(rows.join(known, F.col("_id") == F.col("_key")).select("_stats", "label", "fold"))
