"""Mean imputation, centring and scaling, fitted on training rows only.

``fit`` runs one aggregation over the training rows for all columns and stores the small
result; ``transform`` is a projection, preceded by a lookup of the group's statistics.
Without ``by`` columns the statistics are literals and there is no join at all.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotcast.functions.quoting import name
from slotcast.operators.clean import numeric_columns
from slotcast.operators.sizing import lookup_side, settle


def _adjust(x: str, mean: str, sd: str, impute: bool, center: bool, scale: bool) -> str:
    """An unknown mean leaves the value as it is; an unknown or zero deviation only centres."""
    value = f"coalesce({x}, {mean})" if impute else x
    if center:
        value = f"({value} - coalesce({mean}, 0D))"
    if scale:
        value = f"{value} / coalesce(nullif({sd}, 0D), 1D)"
    return value


def _statistics(c: str, imputed: bool) -> list[str]:
    """Aggregates of one column: mean, population variance and known rows, and the sample
    deviation. Imputed rows lie on the mean: they add nothing to the squares but count as
    rows, so the known rows' variance is spread over all n - 1. NaN is taken as not known."""
    x = f"nanvl(double({name(c)}), cast(NULL AS double))"
    rows = "count(1)" if imputed else f"count({x})"
    return [
        f"avg({x}) AS {name(c + '__mean')}",
        f"var_pop({x}) AS {name(c + '__var')}",
        f"count({x}) AS {name(c + '__known')}",
        f"sqrt(var_pop({x}) * count({x}) / nullif({rows} - 1, 0)) AS {name(c + '__sd')}",
    ]


def _number(value: float | None) -> str:
    if value is None:
        return "cast(NULL AS double)"
    return f"{value!r}D" if math.isfinite(value) else f"double('{value!r}')"


@dataclass(frozen=True)
class Standardiser:
    columns: list[str]
    by: list[str] = field(default_factory=list)
    na_replace: bool = True
    center: bool = True
    scale: bool = True

    def fit(self, train: DataFrame) -> "StandardiserModel":
        numeric = numeric_columns(train, self.columns)
        if not numeric:
            return StandardiserModel(self, [], None, 0, {})
        columns = [F.expr(part) for c in numeric for part in _statistics(c, self.na_replace)]
        stats = train.groupBy(*self.by).agg(F.count(F.lit(1)).alias("n_"), *columns)
        stats = stats.withColumnsRenamed({b: f"{b}__by" for b in self.by})
        if not self.by:
            row = stats.first()
            fixed = {c: (row[f"{c}__mean"], row[f"{c}__sd"]) for c in numeric}
            return StandardiserModel(self, numeric, None, 1, fixed)
        table, groups = settle(stats)
        return StandardiserModel(self, numeric, table, groups, {})


@dataclass(frozen=True)
class StandardiserModel:
    spec: Standardiser
    columns: list[str]
    stats: DataFrame | None
    groups: int
    constants: dict[str, tuple[float | None, float | None]]

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.columns:
            return df
        spec = self.spec
        numbers = set(self.columns)

        def adjusted(column: str) -> str:
            if column not in numbers:
                return f"rows.{name(column)}"
            if self.stats is None:
                mean, sd = (_number(v) for v in self.constants[column])
            else:
                mean, sd = (f"fitted.{name(column + part)}" for part in ("__mean", "__sd"))
            value = _adjust(f"double(rows.{name(column)})", mean, sd, spec.na_replace, spec.center, spec.scale)
            return f"{value} AS {name(column)}"

        out = [adjusted(c) for c in df.columns]
        if self.stats is None:
            return df.alias("rows").selectExpr(*out)
        wanted = [f"{b}__by" for b in spec.by] + [c + part for c in self.columns for part in ("__mean", "__sd")]
        side = lookup_side(self.stats.select(*wanted), self.groups)
        match = F.expr(" AND ".join(f"rows.{name(b)} <=> fitted.{name(b + '__by')}" for b in spec.by))
        return df.alias("rows").join(side.alias("fitted"), match, "left").selectExpr(*out)


@dataclass(frozen=True)
class GroupImputeGlobalScale:
    """Impute by group, then centre and scale over all rows, from one pass over the data:
    the overall mean and deviation of the imputed rows follow from the group statistics.

    With ``rescale=False`` the second step only fills, with the overall mean, what the groups
    could not fill. With ``within``, "all rows" are those that agree in these columns (say, the repeats of a split), and one
    pass fits all of them."""

    columns: list[str]
    by: list[str]
    rescale: bool = True
    within: list[str] = field(default_factory=list)

    def fit(self, train: DataFrame) -> "GroupImputeGlobalScaleModel":
        imputer = Standardiser(self.columns, [*self.within, *self.by], center=False, scale=False).fit(train)
        numeric = imputer.columns
        if not numeric:
            return GroupImputeGlobalScaleModel(imputer, imputer)

        def rows(c: str) -> str:
            return f"CASE WHEN {name(c + '__mean')} IS NOT NULL THEN n_ END"

        if self.within:
            return GroupImputeGlobalScaleModel(imputer, self._within(imputer, rows))

        first = imputer.stats.selectExpr(
            *[f"sum({rows(c)}) AS {name(c + '_n')}" for c in numeric],
            *[f"sum({rows(c)} * {name(c + '__mean')}) / nullif(sum({rows(c)}), 0) AS {name(c + '_mean')}" for c in numeric],
        ).first()

        def squares(c: str) -> str:
            away = f"({name(c + '__mean')} - {_number(first[c + '_mean'])})"
            spread = f"{name(c + '__var')} * {name(c + '__known')}"
            return f"sum({spread} + {rows(c)} * {away} * {away}) AS {name(c)}"

        second = imputer.stats.selectExpr(*[squares(c) for c in numeric]).first()
        constants = {}
        for c in numeric:
            n = first[f"{c}_n"] or 0
            sd = (second[c] / (n - 1)) ** 0.5 if n > 1 else None
            constants[c] = (first[f"{c}_mean"], sd)
        scaler = Standardiser(self.columns, na_replace=not self.rescale, center=self.rescale, scale=self.rescale)
        return GroupImputeGlobalScaleModel(imputer, StandardiserModel(scaler, numeric, None, 1, constants))

    def _within(self, imputer: "StandardiserModel", rows: Callable[[str], str]) -> "StandardiserModel":
        """The same second step for each value of the ``within`` columns, from tables instead of literals."""
        keys = [f"{w}__by" for w in self.within]
        numeric = imputer.columns
        overall = imputer.stats.groupBy(*keys).agg(
            *[F.expr(f"sum({rows(c)})").alias(f"{c}_n") for c in numeric],
            *[F.expr(f"sum({rows(c)} * {name(c + '__mean')}) / nullif(sum({rows(c)}), 0)").alias(f"{c}_mean") for c in numeric],
        ).withColumnsRenamed({k: f"{k}_" for k in keys})
        match = F.expr(" AND ".join(f"{name(k)} <=> {name(k + '_')}" for k in keys))
        both = imputer.stats.join(overall, match)

        def squares(c: str) -> Column:
            away = f"({name(c + '__mean')} - {name(c + '_mean')})"
            return F.expr(f"sum({name(c + '__var')} * {name(c + '__known')} + {rows(c)} * {away} * {away})")

        def number(c: str) -> Column:
            return F.max(f"`{c}_n`")

        table, groups = settle(both.groupBy(*keys).agg(
            *[F.max(f"`{c}_mean`").alias(f"{c}__mean") for c in numeric],
            *[F.when(number(c) > 1, F.sqrt(squares(c) / (number(c) - 1))).alias(f"{c}__sd") for c in numeric],
        ))
        scaler = Standardiser(self.columns, self.within, na_replace=not self.rescale, center=self.rescale, scale=self.rescale)
        return StandardiserModel(scaler, numeric, table, groups, {})


@dataclass(frozen=True)
class GroupImputeGlobalScaleModel:
    imputer: StandardiserModel
    scaler: StandardiserModel

    @property
    def columns(self) -> list[str]:
        return self.imputer.columns

    def transform(self, df: DataFrame) -> DataFrame:
        return self.scaler.transform(self.imputer.transform(df))
