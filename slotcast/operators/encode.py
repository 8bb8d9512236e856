"""One-hot columns with levels fixed in advance or fitted on training rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.fixed import LEVELS
from slotcast.functions.quoting import name, text
from slotcast.operators.levels import Dictionary, sorted_levels

_SHORT = {"y", "n", "Y", "N"}


def find_levels(train: DataFrame, variables: list[str]) -> dict[str, list]:
    """Sorted known values of each variable, from one aggregation. They are the fitted metadata of
    the column form, where every level becomes a column; for a variable with very many, use :class:`SparseOneHot`."""
    missing = [v for v in variables if v not in LEVELS]
    levels = {v: list(LEVELS[v]) for v in variables if v in LEVELS}
    if missing:
        pairs = train.select(F.inline(F.array(*[
            F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("text")) for v in missing
        ]))).filter(F.col("text").isNotNull()).distinct()
        found = pairs.collect()
        for v in missing:
            values = [r["text"] for r in found if r["variable"] == v]
            kind = train.schema[v].dataType.simpleString()
            number = kind in ("int", "bigint", "smallint", "tinyint", "double", "float")
            levels[v] = sorted(values, key=float) if number else sorted(values)
    return {v: levels[v] for v in variables}


@dataclass(frozen=True)
class OneHot:
    variables: list[str]
    levels: dict[str, list] | None = None
    remove: bool = True
    prefix: str = "auto"

    def fit(self, train: DataFrame) -> "OneHotModel":
        given = self.levels or {}
        open_ones = [v for v in self.variables if v not in given]
        found = find_levels(train, open_ones)
        levels = {v: list(given.get(v, found.get(v, []))) for v in self.variables}
        return OneHotModel(levels, _names(levels, self.prefix), self.remove)


def _names(levels: dict[str, list], prefix: str) -> dict[tuple[str, object], str]:
    """Column names: the level itself, with ``variable_`` before it where the level is a yes/no
    letter, true/false or a number, or occurs in two variables; always if asked for."""
    if prefix not in ("auto", "always"):
        raise ValueError("prefix is 'auto' or 'always'")
    every = [str(level) for values in levels.values() for level in values]

    def bare(text: str) -> bool:
        unclear = text in _SHORT or text in ("true", "false") or text.replace(".", "", 1).lstrip("-").isdigit()
        return prefix == "auto" and not unclear and every.count(text) == 1

    return {(v, level): str(level) if bare(str(level)) else f"{v}_{level}"
            for v, values in levels.items() for level in values}


@dataclass(frozen=True)
class OneHotModel:
    levels: dict[str, list]
    names: dict[tuple[str, object], str]
    remove: bool

    @property
    def columns(self) -> list[str]:
        return list(self.names.values())

    def transform(self, df: DataFrame) -> DataFrame:
        """0/1 columns; a NULL or an unknown level has 0 in all columns of its variable."""
        flags = [
            f"int(coalesce(string({name(v)}) = {text(str(level))}, false)) AS {name(column)}"
            for (v, level), column in self.names.items()
        ]
        kept = [c for c in df.columns if not (self.remove and c in self.levels)]
        return df.selectExpr(*[name(c) for c in kept], *flags)


@dataclass(frozen=True)
class SparseOneHot:
    """One sparse vector per variable in place of 0/1 columns, in ``<variable>_vector``; any number of levels."""

    variables: list[str]
    remove: bool = True

    def fit(self, train: DataFrame) -> "SparseOneHotModel":
        """Levels are the known values as text, in alphabetical order, in a written table for each variable."""
        return SparseOneHotModel(self.variables, {v: sorted_levels(train, v, as_text=True) for v in self.variables}, self.remove)


@dataclass(frozen=True)
class SparseOneHotModel:
    variables: list[str]
    dictionaries: dict[str, Dictionary]
    remove: bool

    @property
    def levels(self) -> dict[str, list[str]]:
        """The levels themselves, for variables with few of them."""
        return {v: [r["level"] for r in d.table.orderBy("index").collect()] for v, d in self.dictionaries.items()}

    def indexed(self, df: DataFrame) -> DataFrame:
        """``<variable>_index``: the place of the level, NULL for NULL and unknown ones."""
        out = df.withColumns({f"{v}_text_": F.col(name(v)).cast("string") for v in self.variables})
        for v in self.variables:
            out = self.dictionaries[v].index(out, f"{v}_text_", f"{v}_index")
        kept = [c for c in df.columns if not (self.remove and c in self.variables)]
        return out.select(*[F.col(name(c)) for c in kept], *[F.col(name(f"{v}_index")) for v in self.variables])

    def transform(self, df: DataFrame) -> DataFrame:
        """A NULL or an unknown level has an all-zero vector."""
        sizes = [float(self.dictionaries[v].levels) for v in self.variables]
        inputs, outputs = [f"{v}_index" for v in self.variables], [f"{v}_vector" for v in self.variables]
        # the index after the last level stands for the unknown: the category that is dropped
        one = df.sparkSession.createDataFrame([tuple(sizes)], ", ".join(f"{name(c)} double" for c in inputs))
        encoder = OneHotEncoder(inputCols=inputs, outputCols=outputs, dropLast=True).fit(one)
        rows = self.indexed(df)
        known = rows.withColumns({c: F.coalesce(F.col(name(c)).cast("double"), F.lit(n)) for c, n in zip(inputs, sizes)})
        return encoder.transform(known).drop(*inputs)
