"""Exact quantiles in bounded memory, from two passes over the data.

The first pass brackets every wanted rank with a sketch. The second counts: values inside a
bracket one by one, all others only per region between brackets. Running counts then give the
value at each rank. The counted table holds a small share of the rows, and windows over it are
cut into bins, so no task holds more than the distinct values of one bin. Of a region its smallest and
largest value are known too, so a rank beside a bracket needs no counting: in small groups, where one rank is more than
the margin, that is the rule. The sketch only saves work: should a rank lie deeper in a region, that region is
cut into even bins by a sketch of its own and counted in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotcast.functions.quoting import name, text
from slotcast.operators.fold import unpivot_measures
from slotcast.operators.sizing import lookup_side, settle
from slotcast.session import materialise

ACCURACY = 10_000
MARGIN = 2.0 / ACCURACY
BINS = 256


def _same(names: list[str]) -> str:
    return " AND ".join(f"a.{name(n)} <=> b.{name(n)}" for n in names)


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], by: list[str] | None = None,
                    moments: bool = False) -> DataFrame:
    """One row per group and column: ``variable``, ``n`` known values and ``q0``, ``q1``...,
    one per probability, interpolated linearly between neighbouring ranks.

    ``moments`` adds ``rows``, ``min``, ``mean``, ``max`` and ``sd`` from the first pass.
    """
    return _counted_quantiles(df, columns, probs, by, moments)[0]


def box_counts(df: DataFrame, columns: list[str], reach: float = 1.5, by: list[str] | None = None) -> DataFrame | None:
    """One row per group and column: quartiles ``q1``, ``median``, ``q3``, the last values within ``reach`` box lengths (``whisker_low``, ``whisker_high``) and
    the number of ``outliers`` beyond, from the two passes that find the quartiles.

    The brackets of the quartiles bracket the fences too, so the second pass counts values near the fences one by one. All other regions lie on one side of a
    fence as a whole and give their rows and extremes. None if a quartile lay beside its bracket and a region lies on both sides of a fence.
    """
    keys = [*(by or []), "variable"]
    quantiles, frequencies, groups = _counted_quantiles(df, columns, [0.25, 0.5, 0.75], by, False, reach)
    boxes = materialise(quantiles.selectExpr(
        *[name(k) for k in keys], "q0 AS q1", "q1 AS median", "q2 AS q3", f"q0 - {reach!r}D * (q2 - q0) AS low_fence", f"q2 + {reach!r}D * (q2 - q0) AS high_fence"))
    sides = frequencies.alias("a").join(lookup_side(boxes, groups).alias("b"), F.expr(_same(keys))).selectExpr(
        *[f"a.{name(k)}" for k in keys], "q1", "median", "q3", "low", "high", "here", "low >= low_fence AND high <= high_fence AS inside", "high < low_fence OR low > high_fence AS beyond")
    found = materialise(sides.groupBy(*keys, "q1", "median", "q3").agg(
        F.expr("min(CASE WHEN inside THEN low END) AS whisker_low"), F.expr("max(CASE WHEN inside THEN high END) AS whisker_high"),
        F.expr("coalesce(sum(CASE WHEN beyond THEN here END), 0) AS outliers"), F.expr("bool_or(NOT inside AND NOT beyond) AS torn")))
    if not found.where("torn").isEmpty():
        return None
    return found.select(*keys, "whisker_low", "q1", "median", "q3", "whisker_high", "outliers")


def _counted_quantiles(df: DataFrame, columns: list[str], probs: list[float], by: list[str] | None, moments: bool,
                       reach: float | None = None) -> tuple[DataFrame, DataFrame, int]:
    """The quantiles, the stored frequencies they come from, and the number of groups. With ``reach``, for quartiles, the fences have brackets too."""
    by = list(by or [])
    keys = [*by, "variable"]
    names = [name(k) for k in keys]
    listed = ", ".join(names)
    marks = sorted(min(max(p + side, 0.0), 1.0) for p in probs for side in (-MARGIN, MARGIN))
    asked = {"n": "count({x})", "edges": f"percentile_approx({{x}}, array({', '.join(f'{m!r}D' for m in marks)}), {ACCURACY})"}
    extra = {"rows": "count(1)", "min": "min({x})", "mean": "avg({x})", "max": "max({x})", "sd": "stddev_samp({x})"}
    if moments:
        asked |= extra
    wide = df.groupBy(*by).agg(*[
        F.expr(f"{part.format(x=f'double({name(c)})')} AS {field}_{i}")
        for i, c in enumerate(columns) for field, part in asked.items()])
    per_column = ", ".join(
        f"struct({text(c)} AS variable, {', '.join(f'{field}_{i} AS {field}' for field in asked)})"
        for i, c in enumerate(columns))
    sketch, groups = settle(wide.selectExpr(*[name(b) for b in by], f"inline(array({per_column}))"))
    edges = lookup_side(sketch.select(*keys, "n", "edges"), groups)

    # edges come in pairs (low, high); a value inside a pair is counted by itself. The region
    # grows with the value, and values of one region are all inside a pair or all outside.
    pairs = [(f"edges[{i}]", f"edges[{i + 1}]") for i in range(0, len(marks), 2)]
    if reach is not None:
        r = f"{reach!r}D"
        pairs = [
            (f"(edges[0] - {r} * (edges[5] - edges[0]))", f"(edges[1] - {r} * (edges[4] - edges[1]))"), *pairs,
            (f"(edges[4] + {r} * (edges[4] - edges[1]))", f"(edges[5] + {r} * (edges[5] - edges[0]))"),
        ]
    region = " + ".join(f"int(value >= {low}) + int(value > {high})" for low, high in pairs)
    inside = " OR ".join(f"value BETWEEN {low} AND {high}" for low, high in pairs)
    # all values of a region are in the same pairs, so bins grow with the value in it
    bins = " ".join(f"WHEN value BETWEEN {low} AND {high} THEN coalesce(int(width_bucket(value, {low}, {high}, {BINS})), 0)" for low, high in pairs)
    placed = (
        unpivot_measures(df, by, columns).filter("value IS NOT NULL").alias("a").join(edges.alias("b"), F.expr(_same(keys)))
        .selectExpr(*[f"a.{k}" for k in names], "n", "value", "edges", f"{region} AS region",
                    f"{inside} AS keep")
    )

    positions = [f"(n - 1) * {p!r}D" for p in probs]
    ranks = [f"{f}({at})" for at in positions for f in ("floor", "ceil")]

    def counted(rows: DataFrame, keep: str, bin_: str) -> tuple[DataFrame, DataFrame]:
        """Frequencies (``value`` is NULL where only the region was counted) and, of these,
        the cells that hold a wanted rank."""
        frequencies = materialise(
            rows.selectExpr(*names, "n", "region", f"CASE WHEN NOT ({keep}) THEN -1 ELSE {bin_} END AS bin",
                            f"CASE WHEN {keep} THEN value END AS value", "value AS seen")
            .groupBy(*keys, "n", "region", "bin", "value")
            .agg(F.count(F.lit(1)).alias("here"), F.min("seen").alias("low"), F.max("seen").alias("high")))
        cells = frequencies.groupBy(*keys, "n", "region", "bin").agg(F.sum("here").alias("here")).selectExpr(
            "*", f"sum(here) OVER (PARTITION BY {listed} ORDER BY region, bin) - here AS before")
        hit = " OR ".join(f"({rank} >= before AND {rank} < before + here)" for rank in ranks)
        deep = " OR ".join(f"({rank} > before AND {rank} < before + here - 1)" for rank in ranks)
        return frequencies, cells.filter(hit).selectExpr("*", f"bin = -1 AND ({deep}) AS missed").drop("here", "n")

    own_bin = f"CASE {bins} ELSE 0 END"
    frequencies, cells = counted(placed, "keep", own_bin)
    cells = materialise(cells)
    missed = cells.filter("missed").select(*keys, "region")
    if not missed.isEmpty():
        # at most a row per rank and group; equal shares of the region by a sketch of its own
        missed = lookup_side(materialise(missed), groups * len(ranks))
        shares = ", ".join(f"{k / BINS!r}D" for k in range(1, BINS))
        found = placed.alias("a").join(missed.alias("b"), F.expr(_same([*keys, "region"]))).selectExpr(*[f"a.{k}" for k in names], "a.region", "value")
        cuts, number = settle(found.groupBy(*keys, "region").agg(F.expr(f"percentile_approx(value, array({shares}), {ACCURACY}) AS cuts")))
        again = placed.alias("a").join(lookup_side(cuts, number).alias("b"), F.expr(_same([*keys, "region"])), "left")
        again = again.selectExpr(*[f"a.{k}" for k in names], "n", "value", "edges", "a.region", "keep OR cuts IS NOT NULL AS keep", "cuts")
        frequencies, cells = counted(again, "keep", f"CASE WHEN cuts IS NULL THEN {own_bin} ELSE size(filter(cuts, c -> c < value)) END")
        cells = materialise(cells)

    cells = lookup_side(cells.drop("missed"), groups * len(ranks))
    within = f"PARTITION BY {listed}, region, bin ORDER BY value"
    values = (
        frequencies.alias("a").join(cells.alias("b"), F.expr(_same([*keys, "region", "bin"])))
        .selectExpr(*[f"a.{k}" for k in names], "n", "a.region", "a.bin", "value", "here", "before", "low", "high")
        .selectExpr("*", f"before + sum(here) OVER ({within}) - 1 AS last")
    )

    def at(rank: str) -> str:
        return f"max(CASE WHEN value IS NULL THEN CASE {rank} WHEN last - here + 1 THEN low WHEN last THEN high END WHEN {rank} BETWEEN last - here + 1 AND last THEN value END)"

    found = values.groupBy(*keys, "n").agg(*[
        F.expr(f"{at(f'{f}({position})')} AS {f}{i}") for i, position in enumerate(positions) for f in ("floor", "ceil")])
    quantiles = found.selectExpr(*names, "n", *[
        f"floor{i} + (ceil{i} - floor{i}) * ({position} - floor({position})) AS q{i}"
        for i, position in enumerate(positions)])
    if not moments:
        return quantiles, frequencies, groups
    # a column without known values has moments but no quantiles
    side = lookup_side(quantiles, groups)
    whole = sketch.alias("a").join(side.alias("b"), F.expr(_same(keys)), "left").selectExpr(
        *[f"a.{k}" for k in names], "a.n", *extra, *[f"q{i}" for i in range(len(probs))])
    return whole, frequencies, groups
