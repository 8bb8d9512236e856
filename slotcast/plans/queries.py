"""Registered queries: each takes (spark, folder of Parquet files) and returns a DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotcast import fixed
from slotcast.functions import calendar as cal
from slotcast.functions import stamps
from slotcast.functions.direction import circular_mean, direction_class
from slotcast.operators import clean, combine, fold, metrics, position, profile
from slotcast.operators.encode import OneHot, SparseOneHot
from slotcast.operators.quantiles import exact_quantiles
from slotcast.operators.scaling import GroupImputeGlobalScale, Standardiser
from slotcast.operators.split import exact_split, exact_splits
from slotcast.operators.trees import TreeModel, bag_counts
from slotcast.plans import evaluate, many, plotdata
from slotcast.plans.build import build_tables
from slotcast.plans.features import PREPARATIONS, SCENARIOS, FeatureSet, project, training_table, weather_features
from slotcast.plans.features import prepare as prepare_features
from slotcast.plans.models import Boosting, Forest, TargetModels, as_doubles, fit_formula, fit_targets, formula
from slotcast.plans.stages import fit_pipeline
from slotcast.plans.tables import ahead, cents, hourly_load, measures_with_gaps, slot_weather, table
from slotcast.session import fresh_path, materialise, prepare
from slotcast.sources.delimited import read_delimited, read_results, write_delimited, write_result, write_submission
from slotcast.sources.naming import run_label
from slotcast.sources.snapshots import load_tables, save_tables

# one tree grown to the end over discrete columns predicts group means, which SQL can follow
ONE_TREE = Boosting(rounds=1, step=1.0, min_rows=1, depth=12)
GROUP_SETS = {
    "hour": FeatureSet(factors=[], numerics=[], others=["Hour"]),
    "weekend": FeatureSet(factors=[], numerics=[], others=["f_weekend"]),
    "weekday": FeatureSet(factors=["Weekday"], numerics=[], others=[]),
}
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FLAGS_BY = ["l_returnflag", "l_linestatus"]


def r6(x: Column) -> Column:
    """Six digits, without negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def _rounded(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in columns})


# --- projections, filters, sources -----------------------------------------------------------

def rename_project(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "events").select(F.col("ts").cast("timestamp"), "value")
    return clean.rename_by_position(pairs, fixed.LOAD_COLUMNS)


def time_bound_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = clean.until(table(spark, sf, "events"), "2024-01-22 23:00:00", "ts")
    return kept.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")


def run_labels(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("jobs/nightly/"), F.col("event_type"), F.lit(".job"))
    return table(spark, sf, "events").select("event_id", run_label(F.col("ts"), path, F.col("value")).alias("label"))


def _orders_text(spark: SparkSession, sf: str) -> DataFrame:
    """Orders without the price of pending ones."""
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "dd/MM/yy HH'h'mm").alias("o_date"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("o_totalprice"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("o_orderpriority"),
    )


_ORDERS_TEXT_SCHEMA = T.StructType([
    T.StructField("o_orderkey", T.LongType()),
    T.StructField("o_date", T.StringType()),
    T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderpriority", T.StringType()),
])


def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "csv")
    write_delimited(_orders_text(spark, sf), path)
    return read_delimited(spark, path, _ORDERS_TEXT_SCHEMA, decimal=",")


def csv_line_breaks(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with line breaks, quotes and separators, written and read again by several tasks a file."""
    note = F.concat("o_orderpriority", F.lit('\n"'), F.col("o_orderstatus"), F.lit('";\n\n'), F.col("o_orderkey").cast("string"))
    path = fresh_path(spark, "notes")
    write_delimited(table(spark, sf, "orders").select("o_orderkey", note.alias("note"), "o_totalprice"), path)
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("note", T.StringType()), T.StructField("o_totalprice", T.DoubleType())])
    return read_delimited(spark, path, schema, decimal=",", line_breaks=True)


def result_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs in one folder, blank NULLs, read back with their labels."""
    base = fresh_path(spark, "results")
    orders = _orders_text(spark, sf)
    write_result(orders, base, "20240101_0300_first_8.161")
    write_result(orders.filter(F.col("o_totalprice").isNull()), base, "20240101_0600_second_9.250")
    return read_results(spark, base, _ORDERS_TEXT_SCHEMA)


def parquet_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    folder = fresh_path(spark, "snapshot")
    save_tables({"orders": table(spark, sf, "orders"), "load": hourly_load(spark, sf)}, folder)
    tables = load_tables(spark, folder, ["orders", "load"])
    day = tables["load"].groupBy(F.dayofmonth("datetime").alias("day")).agg(F.count(F.lit(1)).alias("hours"))
    orders = tables["orders"].withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return orders.withColumn("day", F.dayofmonth("o_orderdate")).join(F.broadcast(day), "day", "left")


def _orders_with_copies(spark: SparkSession, sf: str) -> DataFrame:
    text = _orders_text(spark, sf)
    again = text.filter(F.col("o_totalprice") > 250000)
    return text.unionByName(again).unionByName(text.filter(F.col("o_totalprice").isNull()))


def dedup_rows(spark: SparkSession, sf: str) -> DataFrame:
    return clean.drop_duplicate_rows(_orders_with_copies(spark, sf))


def dedup_counts(spark: SparkSession, sf: str) -> DataFrame:
    return clean.duplicate_counts(_orders_with_copies(spark, sf))


# --- stamps, calendar, direction -------------------------------------------------------------

def parse_offset_ts(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    tail = F.when(kind == "error", "").when(kind == "view", "+01:00").otherwise("+02:00")
    text = F.when(kind != "signup", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), tail)).otherwise("not a stamp")
    return table(spark, sf, "events").select("event_id", text.alias("text")).select(
        "event_id",
        stamps.parse_offset_stamp(F.col("text")).alias("datetime"),
        stamps.offset_text(F.col("text")).alias("fuseau"),
        stamps.parse_offset_stamp(F.col("text"), align="utc").alias("datetime_utc"),
    )


def parse_dmy_ts(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("o_orderstatus") == "P", "32/13/16 00h00").otherwise(
        F.date_format("o_orderdate", "dd/MM/yy HH'h'mm"))
    return table(spark, sf, "orders").select("o_orderkey", stamps.parse_day_first_stamp(text).alias("datetime"))


def round_hour(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", stamps.round_to_hour(F.col("ts").cast("timestamp")).alias("datetime"))


def _order_hour() -> Column:
    """Order dates, spread over the hours of the day by customer."""
    return stamps.shift_hours(F.col("o_orderdate").cast("timestamp"), F.pmod(F.col("o_custkey"), F.lit(24)).cast("int"))


def _order_stamps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", _order_hour().alias("datetime"))


def calendar_features(spark: SparkSession, sf: str) -> DataFrame:
    full = cal.with_calendar(_order_stamps(spark, sf))
    return full.withColumns({
        "weekday_rank": cal.level_rank(F.col("Weekday"), fixed.WEEKDAYS),
        "month_rank": cal.level_rank(F.col("Month"), fixed.MONTHS),
        "weekday_short": cal.weekday_name(F.col("datetime"), abbreviated=True),
        "month_short": cal.month_name(F.col("datetime"), abbreviated=True),
    })


def flag_features(spark: SparkSession, sf: str) -> DataFrame:
    flagged = cal.with_flags(_order_stamps(spark, sf))
    return flagged.withColumn("f_ferie_any", cal.holiday_flag(F.col("datetime"), mode="any"))


def direction_bins(spark: SparkSession, sf: str) -> DataFrame:
    degrees = F.when(F.col("event_type") != "error", (F.col("event_id") * 37 % 362 - 1).cast("double"))
    return table(spark, sf, "events").select("event_id", degrees.alias("vt_dir")).withColumn(
        "rose_vt", direction_class(F.col("vt_dir")))


def circular_means(spark: SparkSession, sf: str) -> DataFrame:
    degrees = F.pmod(F.col("event_id") * 37, F.lit(361)).cast("double")
    return table(spark, sf, "events").withColumn("vt_dir", F.when(F.col("value") < 90, degrees / 2)).groupBy(
        "event_type").agg(r6(circular_mean(F.col("vt_dir"))).alias("direction"), F.count("vt_dir").alias("n"))


# --- fold, unfold, joins ---------------------------------------------------------------------

def fold_hours(spark: SparkSession, sf: str) -> DataFrame:
    return fold.fold_hourly(hourly_load(spark, sf))


def fold_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Raw events straight into slots: many rows per hour, the earliest of each counts."""
    raw = table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("datetime"), "event_id", F.col("value").alias("puissance"))
    return fold.fold_hourly(raw, on_duplicate="first", order="event_id", keep_levels=True)


def unfold_predictions(spark: SparkSession, sf: str) -> DataFrame:
    slots = fold_hours(spark, sf)
    hours = [F.struct(F.lit(k).alias("hour"), F.col(f"P{k}").alias("puissance"), F.col(f"chained_P{k}").alias("chained")) for k in range(3)]
    wide = slots.select("datetime", *fold.level_columns(), *[c.alias(f"chained_{n}") for n, c in zip(("P0", "P1", "P2"), fold.level_columns(chained=True))])
    both = wide.select("datetime", F.inline(F.array(*hours))).select(
        stamps.shift_hours(F.col("datetime"), F.col("hour")).alias("datetime"), "puissance", "chained")
    return position.with_position(both, ties=[]).select("datetime", r6(F.col("puissance")).alias("puissance"),
                                                        r6(F.col("chained")).alias("chained"), "position")


def unpivot_measures(spark: SparkSession, sf: str) -> DataFrame:
    return fold.unpivot_measures(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], MEASURES)


def join_weather_filter(spark: SparkSession, sf: str) -> DataFrame:
    weather = weather_features(slot_weather(spark, sf))
    return training_table(hourly_load(spark, sf), weather, required=["P0", "DP1", "DP2", "DP12"])


def _input_files(spark: SparkSession, sf: str) -> tuple[str, str, str]:
    """The two series as raw files: stamps one second early with offset, day-first stamps, copies."""
    load = hourly_load(spark, sf).select(
        F.concat(F.date_format(F.timestamp_add("SECOND", F.lit(-1), F.col("datetime")), "yyyy-MM-dd'T'HH:mm:ss"),
                 F.lit("+02:00")).alias("Date"), "puissance")
    weather = slot_weather(spark, sf).withColumn("datetime", F.date_format("datetime", "dd/MM/yy HH'h'mm"))
    weather = clean.rename_by_position(weather, ["Date UTC", *[f"measure {i}" for i in range(len(weather.columns) - 1)]])
    paths = tuple(fresh_path(spark, n) for n in ("load", "weather", "ahead"))
    write_delimited(load.unionByName(load.filter(F.col("puissance") > 50)), paths[0], decimal=".")
    write_delimited(weather.unionByName(weather.filter(F.col("measure 0").isNotNull())), paths[1], decimal=".", missing="")
    write_delimited(weather, paths[2], decimal=".", missing="")
    return paths


def import_train(spark: SparkSession, sf: str) -> DataFrame:
    """Raw files to the stored training table."""
    return build_tables(spark, *_input_files(spark, sf), fresh_path(spark, "tables"))["data_train"]


def import_ahead(spark: SparkSession, sf: str) -> DataFrame:
    """Raw files to the stored forecast input, up to a time bound."""
    tables = build_tables(spark, *_input_files(spark, sf), fresh_path(spark, "tables"), forecast_end="2024-01-29 23:00:00")
    return tables["data_prev"]


def join_back_left(spark: SparkSession, sf: str) -> DataFrame:
    return combine.join_back(hourly_load(spark, sf), slot_weather(spark, sf))


def tagged_union(spark: SparkSession, sf: str) -> DataFrame:
    load = hourly_load(spark, sf)
    return combine.tagged_union(load.filter(~ahead(load)), load.filter(ahead(load)))


def positional_attach(spark: SparkSession, sf: str) -> DataFrame:
    """Write observed values as a headerless one-column file and attach them by line number."""
    load = materialise(hourly_load(spark, sf))
    path = fresh_path(spark, "vector")
    write_delimited(load.orderBy("datetime").select((F.col("puissance") * 2 + 1).alias("v")), path,
                    decimal=".", header=False)
    vector = position.read_positions(spark, path, "reality double")
    placed = position.with_position(load, ties=[])
    return position.attach_by_position(placed, vector, "reality", after="puissance")


def _hour_means(load: DataFrame) -> DataFrame:
    """Forecast each hour of the horizon by the training mean of its hour of day."""
    known = load.withColumn("Hour", F.hour("datetime"))
    means = known.filter(~ahead(known)).groupBy("Hour").agg(F.avg("puissance").alias("guess"))
    # 24 hours of day
    return known.filter(ahead(known)).join(F.broadcast(means), "Hour", "left").select(
        "datetime", F.col("guess").alias("puissance"), F.col("puissance").alias("reality"))


def row_error_pct(spark: SparkSession, sf: str) -> DataFrame:
    scored = metrics.with_row_error(_hour_means(hourly_load(spark, sf)))
    return _rounded(scored, ["puissance", "mape"])


# --- profiles --------------------------------------------------------------------------------

def na_profile(spark: SparkSession, sf: str) -> DataFrame:
    gaps = measures_with_gaps(spark, sf, ["l_orderkey", *FLAGS_BY])
    gaps = gaps.withColumn("l_linestatus", F.nullif(F.col("l_linestatus"), F.lit("O")))
    return _rounded(profile.null_profile(gaps), ["p_na"])


def table_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = profile.table_summary(measures_with_gaps(spark, sf, []), MEASURES)
    return _rounded(out, ["min", "q1", "median", "mean", "q3", "max", "sd"])


def boxplot_stats(spark: SparkSession, sf: str) -> DataFrame:
    values = table(spark, sf, "events").select("value", F.when(F.col("event_type") != "error", F.col("value")).alias("valid"))
    out = profile.box_numbers(values, ["value", "valid"])
    return _rounded(out, ["whisker_low", "q1", "median", "q3", "whisker_high"])


def boxplot_outliers(spark: SparkSession, sf: str) -> DataFrame:
    values = table(spark, sf, "events").select("value", F.when(F.col("event_type") != "error", F.col("value")).alias("valid"))
    return profile.box_outliers(values, ["value", "valid"])


def boxplot_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Quartiles per group and measure."""
    out = exact_quantiles(measures_with_gaps(spark, sf, FLAGS_BY), MEASURES, profile.QUARTILES, FLAGS_BY)
    return _rounded(out, ["q0", "q1", "q2"])


def profile_month_hour(spark: SparkSession, sf: str) -> DataFrame:
    full = cal.with_calendar(hourly_load(spark, sf))
    return _rounded(profile.group_profile(full, ["Month", "Hour"]), ["moy_puiss", "std_puiss"])


def profile_year_month_hour(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    priced = orders.select(_order_hour().alias("datetime"), cents(F.col("o_totalprice")).alias("puissance"))
    full = cal.with_calendar(priced, abbreviated=True)
    full = full.withColumn("year_month", F.concat_ws("-", "Year", "Month"))
    levels = profile.first_seen_rank(full, "year_month")
    groups = profile.group_profile(full, ["year_month", "Month", "Hour"])
    return groups.join(levels, "year_month").withColumn("std_puiss", F.round("std_puiss", 3))


def crosstab_stats(spark: SparkSession, sf: str) -> DataFrame:
    priced = table(spark, sf, "orders").select("o_orderdate", cents(F.col("o_totalprice")).alias("temp"))
    full = cal.with_calendar(priced, "o_orderdate")
    out = profile.crosstab(full, "Weekday", "Month", fixed.MONTHS, "temp")
    return out.withColumns({f"{m}_sd": F.round(f"{m}_sd", 3) for m in fixed.MONTHS})


# --- imputation and scaling ------------------------------------------------------------------

def _scaled_items(spark: SparkSession, sf: str, scaler: Standardiser | GroupImputeGlobalScale) -> DataFrame:
    """Fit on line items shipped before mid-2000 and apply to all of them."""
    items = measures_with_gaps(spark, sf, ["l_orderkey", *FLAGS_BY, "l_shipdate"])
    later = F.col("l_shipdate") >= F.lit("2000-07-01").cast(items.schema["l_shipdate"].dataType)
    fitted = scaler.fit(items.filter(~later))
    out = fitted.transform(items.withColumn("DATA_", F.when(later, "test").otherwise("train")))
    return _rounded(out.drop("l_shipdate"), MEASURES)


def impute_global(spark: SparkSession, sf: str) -> DataFrame:
    return _scaled_items(spark, sf, Standardiser(MEASURES, center=False, scale=False))


def impute_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return _scaled_items(spark, sf, Standardiser(MEASURES, FLAGS_BY, center=False, scale=False))


def scale_global(spark: SparkSession, sf: str) -> DataFrame:
    """All columns are offered; only the numeric ones are scaled."""
    return _scaled_items(spark, sf, Standardiser(["l_returnflag", *MEASURES]))


def scale_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return _scaled_items(spark, sf, Standardiser(MEASURES, FLAGS_BY))


def impute_group_scale_global(spark: SparkSession, sf: str) -> DataFrame:
    return _scaled_items(spark, sf, GroupImputeGlobalScale(MEASURES, FLAGS_BY))


def scaled_moments(spark: SparkSession, sf: str) -> DataFrame:
    """After scaling, the training rows of every column have mean 0 and deviation 1."""
    items = measures_with_gaps(spark, sf, [])
    out = profile.moments(Standardiser(MEASURES).fit(items).transform(items), MEASURES)
    return _rounded(out, ["mean", "sd"])


def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The dense model input of the final scenario, one row per cell."""
    features = SCENARIOS[7]
    slots = materialise(project(weather_features(slot_weather(spark, sf)), features))
    train, test = slots.filter(~ahead(slots)), slots.filter(ahead(slots))
    ready, asked, columns = prepare_features(train, test, features)
    rows = as_doubles(combine.tagged_union(ready, asked), columns)
    matrix = VectorAssembler(inputCols=columns, outputCol="features").transform(rows)
    cells = matrix.select("datetime", "DATA_", F.posexplode(vector_to_array("features")).alias("position", "value"))
    return _rounded(cells, ["value"])


def fit_transfer(spark: SparkSession, sf: str) -> DataFrame:
    """Slot covariates, standardised by weekday and hour of the training period."""
    measures = ["temp", "pression", "vt_moy", "vt_raf", "rr_3h", "nebul"]
    slots = cal.with_calendar(slot_weather(spark, sf)).select("datetime", "Weekday", "Hour", *measures)
    train, test = slots.filter(~ahead(slots)), slots.filter(ahead(slots))
    fitted = Standardiser(measures, ["Weekday", "Hour"]).fit(train)
    return _rounded(combine.tagged_union(fitted.transform(train), fitted.transform(test)), measures)


# --- encoding, splitting ---------------------------------------------------------------------

def _order_factors(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    full = cal.with_calendar(orders.withColumn("datetime", F.col("o_orderdate").cast("timestamp")))
    return full.select("o_orderkey", "datetime", "Weekday", "Month", "Year",
                       F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"),
                       cal.is_weekend(F.col("datetime")).alias("f_weekend"))


def onehot(spark: SparkSession, sf: str) -> DataFrame:
    factors = _order_factors(spark, sf).drop("Year", "datetime")
    return OneHot(["Weekday", "Month", "o_orderstatus", "f_weekend"]).fit(factors).transform(factors)


def onehot_fit_transfer(spark: SparkSession, sf: str) -> DataFrame:
    """Levels come from the years before 1999; later years have no column of their own."""
    factors = _order_factors(spark, sf).select("o_orderkey", "datetime", "Year", "o_orderstatus")
    later = F.col("datetime") >= F.lit("1999-01-01").cast("timestamp")
    train, test = factors.filter(~later), factors.filter(later)
    encoder = OneHot(["Year", "o_orderstatus"], remove=False, prefix="always").fit(train)
    return combine.tagged_union(encoder.transform(train), encoder.transform(test)).drop("datetime")


def scenario_projection(spark: SparkSession, sf: str) -> DataFrame:
    return project(weather_features(slot_weather(spark, sf)), SCENARIOS[7])


def scenario_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Every variable of each of the eight sets in its place: factors as text, the others as numbers."""
    slots = materialise(weather_features(slot_weather(spark, sf)))

    def cells(number: int) -> DataFrame:
        features = SCENARIOS[number]
        rows = project(slots, features)
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        each = F.array(*[
            F.struct(
                F.lit(i).alias("position"), F.lit(v).alias("variable"),
                (F.col(v) if isinstance(kinds[v], T.StringType) else F.lit(None).cast("string")).alias("text"),
                (F.lit(None).cast("double") if isinstance(kinds[v], T.StringType) else F.col(v).cast("int" if isinstance(kinds[v], T.BooleanType) else "double").cast("double")).alias("number"),
            ) for i, v in enumerate(features.variables)
        ])
        return rows.select(F.lit(number).alias("scenario"), "datetime", F.inline(each))

    return reduce(DataFrame.unionByName, [cells(n) for n in SCENARIOS])


def formula_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The matrix that a formula makes of a number and two texts: levels by falling frequency in training rows, no column for a NULL or an unseen level."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", cents(F.col("o_totalprice")).cast("double").alias("price"), F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("priority"), F.col("o_orderstatus").alias("status"))
    model = formula("price", ["price", "priority", "status"]).fit(orders.where("status <> 'P'"))
    made = model.transform(orders)
    return made.select("o_orderkey", F.posexplode(vector_to_array("features")).alias("position", "value"))


def sparse_onehot(spark: SparkSession, sf: str) -> DataFrame:
    """Places of order keys among the keys of orders before 1998, one level for each order, as sparse vectors would hold them."""
    known = table(spark, sf, "orders").where("o_orderdate < '1998-01-01'").select(F.col("o_orderkey").alias("l_orderkey"))
    model = SparseOneHot(["l_orderkey"], remove=False).fit(known)
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return model.indexed(items).withColumn("size", F.lit(model.dictionaries["l_orderkey"].levels))


def level_order(spark: SparkSession, sf: str) -> DataFrame:
    """Order keys in the order in which their first item was shipped."""
    return profile.first_seen_rank(table(spark, sf, "lineitem"), "l_orderkey", "l_shipdate")


def exact_split_rows(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "value")
    return exact_split(events, "event_id", fixed.HOLDOUT_TRAIN_SHARE, seed=7).tagged()


def per_target_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The rows each target's model may learn from."""
    return fold.labelled_rows(fold_hours(spark, sf), fixed.TARGETS, ["datetime"])


# --- errors ----------------------------------------------------------------------------------

def error_metrics(spark: SparkSession, sf: str) -> DataFrame:
    scored = _hour_means(hourly_load(spark, sf)).withColumn("Weekday", cal.weekday_name(F.col("datetime")))
    return _rounded(metrics.error_metrics(scored, by=["Weekday"]), ["rmse", "mape", "mae"])


def error_metrics_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Truth with gaps and zeros: strict and lenient measures per event type."""
    events = table(spark, sf, "events").select(
        "event_type", F.lit(50.0).alias("puissance"),
        F.when((F.col("event_type") == "view") | (F.col("value") < 400), F.floor("value").cast("double")).alias("reality"))
    strict = metrics.error_metrics(events, by=["event_type"]).withColumn("strict", F.lit(True))
    lenient = metrics.error_metrics(events, by=["event_type"], strict=False).withColumn("strict", F.lit(False))
    return _rounded(strict.unionByName(lenient), ["rmse", "mape", "mae"])


def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """Three group-mean predictors over three exact splits of the hours."""
    hours = materialise(cal.with_calendar(hourly_load(spark, sf)))
    splits = exact_splits(hours, "datetime", [1, 2, 3], fixed.HOLDOUT_TRAIN_SHARE, rounding="floor")
    sides = F.inline(F.array(*[
        F.struct(F.lit(s).alias("repeat"), split.is_train.alias("is_train")) for s, split in splits.items()]))
    runs = hours.select("*", sides)
    learnt = F.when(F.col("is_train"), F.col("puissance"))
    overall = runs.groupBy("repeat").agg(F.avg(learnt).alias("overall"))

    def score(name: str, keys: list[str]) -> DataFrame:
        means = runs.groupBy("repeat", *keys).agg(F.avg(learnt).alias("guess"))
        # hours of the week at most, and three repeats
        scored = (
            runs.filter(~F.col("is_train")).join(F.broadcast(means), ["repeat", *keys], "left")
            .join(F.broadcast(overall), "repeat")
            .select("repeat", F.coalesce("guess", "overall").alias("guess"), "puissance")
        )
        errors = metrics.error_metrics(scored, "guess", "puissance", by=["repeat"])
        return errors.select(F.lit(name).alias("scenario"), "repeat", (F.col("mape") * 100).alias("mape"), "rmse")

    results = materialise(reduce(DataFrame.unionByName, [
        score("hour", ["Hour"]), score("weekday", ["Weekday"]), score("hour of week", ["Weekday", "Hour"])]))
    board = metrics.leaderboard(results).join(
        F.broadcast(metrics.best(results)).select("scenario", F.lit(True).alias("is_best")), "scenario", "left")
    return _rounded(board.fillna({"is_best": False}), ["min", "q1", "median", "mean", "q3", "max"])


# --- chart tables ----------------------------------------------------------------------------

def plot_data_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(plotdata.forecast_chart(_hour_means(hourly_load(spark, sf))), ["puissance"])


def plot_data_series(spark: SparkSession, sf: str) -> DataFrame:
    weather = cal.with_calendar(slot_weather(spark, sf))
    measures = [c for c in fixed.WEATHER_COLUMNS[1:] if c != "neige"]
    return plotdata.measure_chart(weather, measures)


def plot_data_load(spark: SparkSession, sf: str) -> DataFrame:
    return plotdata.load_chart(hourly_load(spark, sf))


# --- models ----------------------------------------------------------------------------------

def _train_and_ahead(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Training slots with a load, and every slot ahead: one without measures has NULLs, which imputation fills."""
    seen = materialise(slot_weather(spark, sf))
    step = F.expr(f"INTERVAL {fixed.SLOT_HOURS} HOURS")
    slots = seen.agg(F.min("datetime").alias("low"), F.max("datetime").alias("high")).where("low IS NOT NULL").select(
        F.explode(F.sequence("low", "high", step)).alias("datetime"))
    weather = materialise(weather_features(slots.join(seen, "datetime", "left")))
    train = training_table(hourly_load(spark, sf), weather.filter(~ahead(weather)), required=["P0"], keep_levels=True)
    return materialise(train), weather.filter(ahead(weather))


def gbt_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Slot-level predictions of the three boosted models with the final set's fixed parameters, all 300 rounds."""
    train, slots = _train_and_ahead(spark, sf)
    return many.predict_ahead(train, slots, {7: SCENARIOS[7]}, preparation="impute_group_scale_global").drop("scenario")


def rf_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Forests of 500 trees by formula, on factors as they are, carried to hourly errors."""
    train, slots = _train_and_ahead(spark, sf)
    features = SCENARIOS[2]
    fitted = Standardiser(features.numerics, ["Month", "Hour"]).fit(train)
    numbers = [*features.numerics, *features.others]
    models = fit_formula(as_doubles(fitted.transform(train), numbers), [*numbers, *features.factors], fixed.TARGETS, Forest())
    predicted = models.predict(as_doubles(fitted.transform(slots), numbers))
    hourly = fold.unfold(fold.recompose(predicted.select("datetime", *fixed.TARGETS)))
    reality = hourly_load(spark, sf).select("datetime", F.col("puissance").alias("reality"))
    return metrics.with_row_error(hourly.join(reality, "datetime", "left"))


def gbt_hour_means(spark: SparkSession, sf: str) -> DataFrame:
    """One boosted round that splits on every hour predicts the training mean of each hour,
    so the way from fitting to hourly errors can be followed in SQL."""
    train, slots = _train_and_ahead(spark, sf)
    models = fit_targets(as_doubles(train, ["Hour"]), ["Hour"], fixed.TARGETS, ONE_TREE)
    predicted = models.predict(as_doubles(slots, ["Hour"])).select("datetime", *fixed.TARGETS)
    hourly = fold.unfold(fold.recompose(predicted))
    reality = hourly_load(spark, sf).select("datetime", F.col("puissance").alias("reality"))
    return _rounded(metrics.with_row_error(hourly.join(reality, "datetime", "left")), ["puissance", "mape"])


def rf_weekday_means(spark: SparkSession, sf: str) -> DataFrame:
    """One deep tree over all rows, on a text factor, predicts the training mean of each weekday."""
    train, slots = _train_and_ahead(spark, sf)
    one_tree = Forest(trees=1, depth=10, min_rows=1, bootstrap=False)
    models = fit_targets(train, ["Weekday"], fixed.TARGETS, one_tree, categories=["Weekday"])
    return _rounded(models.predict(slots).select("datetime", *fixed.TARGETS), fixed.TARGETS)


def model_io(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of models that were saved and loaded again."""
    train, slots = _train_and_ahead(spark, sf)
    models = fit_targets(as_doubles(train, ["Hour"]), ["Hour"], fixed.TARGETS, ONE_TREE)
    folder = fresh_path(spark, "models")
    models.save(spark, folder)
    again = TargetModels.load(spark, folder, fixed.TARGETS, ["Hour"])
    return _rounded(again.predict(as_doubles(slots, ["Hour"])).select("datetime", *fixed.TARGETS), fixed.TARGETS)


def pipeline_io(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions for raw slots by a saved and loaded pipeline of preparation and models, and whether the pipeline gave them before it was saved."""
    train, slots = _train_and_ahead(spark, sf)
    model = fit_pipeline(train, SCENARIOS[7], Boosting(rounds=3, step=0.3, depth=5))
    folder = fresh_path(spark, "pipeline")
    model.write().save(folder)
    hats = [f"{t}_hat" for t in fixed.TARGETS]
    before = model.transform(slots).select("datetime", F.struct(*hats).alias("before"))
    after = PipelineModel.load(folder).transform(slots).select("datetime", *hats)
    return after.join(before, "datetime").select("datetime", *hats, F.struct(*hats).eqNullSafe(F.col("before")).alias("same"))


def repeated_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """All 70 repeats for a model that predicts the training mean of each hour."""
    train, _ = _train_and_ahead(spark, sf)
    errors = evaluate.scenario_sweep(train, ONE_TREE, sets={"hour": GROUP_SETS["hour"]}, parallelism=8)
    return _rounded(errors, ["mape", "rmse", "mae"])


def holdout_hour_means(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated hold-out of a model that predicts the training mean of each hour."""
    train, _ = _train_and_ahead(spark, sf)
    errors = evaluate.repeated_holdout(train, GROUP_SETS["hour"], ONE_TREE, seeds=[1, 2, 3], scenario="hour means", parallelism=3)
    return _rounded(errors, ["mape", "rmse", "mae"])


def scenario_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Three feature sets over the same five splits, for each of the four preparations."""
    train, _ = _train_and_ahead(spark, sf)
    runs = [evaluate.scenario_sweep(train, ONE_TREE, seeds=range(1, 6), sets=GROUP_SETS, preparation=p, parallelism=5) for p in PREPARATIONS]
    return _rounded(reduce(DataFrame.unionByName, runs), ["mape", "rmse", "mae"])


def forecast_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """The forecast of three feature sets, written to result files and read back."""
    train, slots = _train_and_ahead(spark, sf)
    reality = materialise(hourly_load(spark, sf).select("datetime", F.col("puissance").alias("reality")))
    base = fresh_path(spark, "submissions")
    errors = evaluate.forecast_sweep(train, slots, reality, ONE_TREE, sets=GROUP_SETS, base=base, parallelism=3, strict=False)
    schema = T.StructType([T.StructField("datetime", T.TimestampType()), *[T.StructField(n, T.DoubleType()) for n in ("puissance", "reality", "mape")]])
    hours = read_results(spark, base, schema).groupBy("run").agg(F.count(F.lit(1)).alias("hours"), F.min("datetime").alias("first_hour"))
    key = F.regexp_extract("run", "_forecast([^_]*)_", 1)
    # one run per set
    both = errors.join(F.broadcast(hours), key == F.col("scenario"), "left").drop("repeat", "run")
    return _rounded(both, ["mape", "rmse", "mae"])


def submission_file(spark: SparkSession, sf: str) -> DataFrame:
    """A forecast as a bare column of values, read back by line."""
    train, slots = _train_and_ahead(spark, sf)
    models = fit_targets(as_doubles(train, ["Hour"]), ["Hour"], fixed.TARGETS, ONE_TREE)
    hourly = fold.unfold(fold.recompose(models.predict(as_doubles(slots, ["Hour"])).select("datetime", *fixed.TARGETS)))
    path = fresh_path(spark, "submission")
    write_submission(hourly, path)
    return position.read_positions(spark, path, "v double").select("position", r6(F.col("v")).alias("v"))


def final_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """The whole way: features, final scenario, three models of 300 rounds, hourly forecast, row errors."""
    train, slots = _train_and_ahead(spark, sf)
    hourly = many.forecast(train, slots)
    reality = hourly_load(spark, sf).select("datetime", F.col("puissance").alias("reality"))
    scored = metrics.with_row_error(hourly.join(reality, "datetime", "left"))
    front = ["datetime", "puissance", "reality", "mape"]
    return scored.select(*front, *[c for c in scored.columns if c not in front])


def repeated_holdout_full(spark: SparkSession, sf: str) -> DataFrame:
    """The published evaluation: 70 repeats of the final set, three models of 300 rounds each."""
    train, _ = _train_and_ahead(spark, sf)
    return many.sweep(train, sets={7: SCENARIOS[7]})


def scenario_sweep_full(spark: SparkSession, sf: str) -> DataFrame:
    """All eight sets under the four preparations, 70 repeats each, with single trees."""
    train, _ = _train_and_ahead(spark, sf)
    one = Boosting(rounds=1, step=1.0, min_rows=5)
    return reduce(DataFrame.unionByName, [many.sweep(train, one, sets=SCENARIOS, preparation=p, penalty=0.0) for p in PREPARATIONS])


def scenario_sweep_means(spark: SparkSession, sf: str) -> DataFrame:
    """Three one-variable sets over all 70 repeats; single trees predict training means, which SQL can follow."""
    train, _ = _train_and_ahead(spark, sf)
    return _rounded(many.sweep(train, ONE_TREE, sets=GROUP_SETS, penalty=0.0), ["mape", "rmse", "mae"])


def repeat_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and deviation of each numeric variable on the train side of each of 70 splits, by hour, from one aggregation."""
    train, _ = _train_and_ahead(spark, sf)
    numerics = SCENARIOS[2].numerics
    long = many.split_rows(train.select("datetime", "Hour", *numerics), "datetime", range(fixed.HOLDOUT_REPEATS), fixed.HOLDOUT_TRAIN_SHARE)
    fitted = Standardiser(numerics, ["repeat", "Hour"]).fit(long.where("train"))
    long_stats = F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__sd").alias("sd")) for c in numerics]))
    # moved by far less than the last digit, so that a mean that ends in five is no tie
    stats = fitted.stats.select(F.col("repeat__by").alias("repeat"), F.col("Hour__by").alias("Hour"), F.col("n_").alias("n"), long_stats)
    return stats.withColumns({c: F.round(F.col(c) + F.lit(1e-9), 6) + F.lit(0.0) for c in ("mean", "sd")})


def forest_bags(spark: SparkSession, sf: str) -> DataFrame:
    """How often each of 20 bags holds each order."""
    orders = table(spark, sf, "orders")
    return bag_counts(orders, "o_orderkey", TreeModel(0, (0,), rounds=20, bagging=True)).groupBy("tree", "times").agg(F.count(F.lit(1)).alias("rows"), F.sum("row").alias("keys"))


def forest_out_of_bag(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-bag predictions of a forest of 25 stumps on the hour, with their errors."""
    train, _ = _train_and_ahead(spark, sf)
    unseen = many.out_of_bag(train, ["Hour"], Forest(trees=25, depth=1)).withColumnsRenamed({t: f"{t}_hat" for t in fixed.TARGETS})
    both = unseen.join(train.select("datetime", *fixed.TARGETS), "datetime")
    return _rounded(both.select("datetime", *[f"{t}_hat" for t in fixed.TARGETS], *[F.abs(F.col(t) - F.col(f"{t}_hat")).alias(f"{t}_error") for t in fixed.TARGETS]),
                    [f"{t}_{k}" for t in fixed.TARGETS for k in ("hat", "error")])


def forest_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-bag errors of forests of 500 deep trees that draw a third of the final set's columns for each node."""
    train, _ = _train_and_ahead(spark, sf)
    numbers = [c for c in SCENARIOS[7].numerics + SCENARIOS[7].others]
    ready = Standardiser(SCENARIOS[7].numerics, ["Month", "Hour"]).fit(train).transform(train)
    unseen = many.out_of_bag(ready, numbers, Forest()).withColumnsRenamed({t: f"{t}_hat" for t in fixed.TARGETS})
    both = unseen.join(train.select("datetime", *fixed.TARGETS), "datetime")
    each = F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"{t}_hat").alias("puissance"), F.col(t).alias("reality")) for t in fixed.TARGETS])
    return metrics.error_metrics(both.select(F.inline(each)), by=["target"], strict=False).drop("mape", "zero_truths")


def forecast_sweep_full(spark: SparkSession, sf: str) -> DataFrame:
    """The final forecast of each of the eight sets with its own fixed boosting parameters, against what was observed."""
    train, slots = _train_and_ahead(spark, sf)
    reality = hourly_load(spark, sf).select("datetime", F.col("puissance").alias("reality"))
    return many.forecast_errors(train, slots, reality, strict=False)


QUERIES = {
    "rename_project": rename_project,
    "time_bound_filter": time_bound_filter,
    "run_label": run_labels,
    "csv_roundtrip": csv_roundtrip,
    "csv_line_breaks": csv_line_breaks,
    "result_sink": result_sink,
    "parquet_roundtrip": parquet_roundtrip,
    "dedup_rows": dedup_rows,
    "dedup_counts": dedup_counts,
    "parse_offset_ts": parse_offset_ts,
    "parse_dmy_ts": parse_dmy_ts,
    "round_hour": round_hour,
    "calendar_features": calendar_features,
    "flag_features": flag_features,
    "direction_bins": direction_bins,
    "circular_mean": circular_means,
    "fold_hourly": fold_hours,
    "fold_duplicates": fold_duplicates,
    "unfold_predictions": unfold_predictions,
    "unpivot_measures": unpivot_measures,
    "join_weather_filter": join_weather_filter,
    "import_train": import_train,
    "import_ahead": import_ahead,
    "join_back_left": join_back_left,
    "tagged_union": tagged_union,
    "positional_attach": positional_attach,
    "row_error_pct": row_error_pct,
    "na_profile": na_profile,
    "table_summary": table_summary,
    "boxplot_stats": boxplot_stats,
    "boxplot_outliers": boxplot_outliers,
    "boxplot_groups": boxplot_groups,
    "profile_month_hour": profile_month_hour,
    "profile_year_month_hour": profile_year_month_hour,
    "crosstab_stats": crosstab_stats,
    "impute_global": impute_global,
    "impute_by_group": impute_by_group,
    "scale_global": scale_global,
    "scale_by_group": scale_by_group,
    "impute_group_scale_global": impute_group_scale_global,
    "scaled_moments": scaled_moments,
    "fit_transfer": fit_transfer,
    "feature_matrix": feature_matrix,
    "onehot": onehot,
    "onehot_fit_transfer": onehot_fit_transfer,
    "scenario_projection": scenario_projection,
    "scenario_cells": scenario_cells,
    "formula_matrix": formula_matrix,
    "sparse_onehot": sparse_onehot,
    "level_order": level_order,
    "exact_split": exact_split_rows,
    "per_target_rows": per_target_rows,
    "error_metrics": error_metrics,
    "error_metrics_gaps": error_metrics_gaps,
    "leaderboard": leaderboard,
    "plot_data_forecast": plot_data_forecast,
    "plot_data_series": plot_data_series,
    "plot_data_load": plot_data_load,
    "gbt_forecast": gbt_forecast,
    "rf_forecast": rf_forecast,
    "gbt_hour_means": gbt_hour_means,
    "rf_weekday_means": rf_weekday_means,
    "model_io": model_io,
    "pipeline_io": pipeline_io,
    "repeated_holdout": repeated_holdout,
    "holdout_hour_means": holdout_hour_means,
    "scenario_sweep": scenario_sweep,
    "forecast_sweep": forecast_sweep,
    "submission_file": submission_file,
    "final_forecast": final_forecast,
    "repeated_holdout_full": repeated_holdout_full,
    "scenario_sweep_full": scenario_sweep_full,
    "scenario_sweep_means": scenario_sweep_means,
    "repeat_statistics": repeat_statistics,
    "forecast_sweep_full": forecast_sweep_full,
    "forest_bags": forest_bags,
    "forest_out_of_bag": forest_out_of_bag,
    "forest_errors": forest_errors,
}


def registered() -> dict:
    """Every query, with the session's time zone pinned before it is built."""
    def pinned(build):
        return lambda spark, sf_dir: build(prepare(spark), sf_dir)

    return {name: pinned(build) for name, build in QUERIES.items()}
