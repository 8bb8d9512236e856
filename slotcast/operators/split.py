"""Exact random split as a row-local predicate.

A seeded hash orders the rows; the train side is the first n. The cutoff is found from
histograms of the hash (at most 65,536 bins each), so no data row is shuffled or ranked and
both sides remain plain filters over the source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from slotcast.fixed import SPLIT_TRAIN_SHARE


def split_hash(key: str, seed: Column) -> Column:
    """32 bits of the MD5 of seed and key, as a non-negative long."""
    text = F.concat_ws("|", seed.cast("string"), F.col(key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


@dataclass(frozen=True)
class Split:
    """Rows at or before the cutoff (hash, key) are train, all others test."""

    df: DataFrame
    key: str
    seed: int
    train_rows: int
    rows: int
    cut_hash: int
    cut_key: object

    @property
    def is_train(self) -> Column:
        if self.train_rows == 0:
            return F.lit(False)
        if self.train_rows == self.rows:
            return F.lit(True)
        h = split_hash(self.key, F.lit(self.seed))
        if self.cut_key is None:
            return h <= self.cut_hash
        key_type = self.df.schema[self.key].dataType
        tie = (h == self.cut_hash) & (F.col(self.key) <= F.lit(self.cut_key).cast(key_type))
        return F.coalesce((h < self.cut_hash) | tie, F.lit(False))

    @property
    def train(self) -> DataFrame:
        return self.df.filter(self.is_train)

    @property
    def test(self) -> DataFrame:
        return self.df.filter(~self.is_train)

    def tagged(self, tag: str = "DATA_") -> DataFrame:
        return self.df.withColumn(tag, F.when(self.is_train, "train").otherwise("test"))


def _locate(histogram: DataFrame, by: str, place: str) -> dict[int, Row]:
    """Per seed, the bin that holds a place: its rows, the rows up to its end, all rows."""
    running = histogram.selectExpr(
        "*", f"sum(rows) OVER (PARTITION BY seed ORDER BY {by}) AS through", "sum(rows) OVER (PARTITION BY seed) AS total")
    hit = running.selectExpr("*", f"{place} AS place").filter("through >= place AND through - rows < place")
    return {r["seed"]: r for r in hit.collect()}


def _per_seed(values: dict[int, int]) -> str:
    return "CASE seed " + " ".join(f"WHEN {s} THEN {v}" for s, v in values.items()) + " END"


def exact_splits(df: DataFrame, key: str, seeds: list[int], share: float = SPLIT_TRAIN_SHARE,
                 rounding: str = "round") -> dict[int, Split]:
    """One split per seed, from two passes over the keys. ``key`` must be known and unique;
    it breaks ties of the hash."""
    if rounding not in ("round", "floor"):
        raise ValueError("rounding is 'round' or 'floor'")
    wanted_rows = f"bigint(bround({share!r}D * total, 0))" if rounding == "round" else f"bigint(floor({share!r}D * total))"
    seed = F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed")
    hashed = df.select(F.col(key).alias("key"), seed).select(
        "seed", "key", split_hash("key", F.col("seed")).alias("h")).withColumn("bin", F.expr("h DIV 65536"))

    def histogram(rows: DataFrame, by: str) -> DataFrame:
        return rows.groupBy("seed", by).agg(F.count(F.lit(1)).alias("rows"))

    outer = _locate(histogram(hashed, "bin"), "bin", wanted_rows)
    if not outer:  # nothing to learn from: no rows, or a share that rounds to none
        return {s: Split(df, key, s, 0, -1, -1, None) for s in seeds}
    left = {s: r["place"] - (r["through"] - r["rows"]) for s, r in outer.items()}
    inside = hashed.filter("bin = " + _per_seed({s: r["bin"] for s, r in outer.items()}))
    inner = _locate(histogram(inside, "h"), "h", _per_seed(left))
    left = {s: r["place"] - (r["through"] - r["rows"]) for s, r in inner.items()}

    ties: dict[int, Row] = {}
    tied = {s: r["h"] for s, r in inner.items() if left[s] < r["rows"]}
    if tied:
        at_cut = inside.filter("h = " + _per_seed(tied))
        ties = _locate(histogram(at_cut, "key"), "key", _per_seed({s: left[s] for s in tied}))
        for s, r in ties.items():
            if r["through"] != left[s]:
                raise ValueError(f"key {r['key']!r} occurs {r['rows']} times; the split needs a unique key")
    return {
        s: Split(df, key, s, outer[s]["place"], outer[s]["total"], inner[s]["h"], ties[s]["key"] if s in ties else None)
        for s in seeds
    }


def exact_split(df: DataFrame, key: str, share: float = SPLIT_TRAIN_SHARE, seed: int = 0,
                rounding: str = "round") -> Split:
    return exact_splits(df, key, [seed], share, rounding)[seed]
