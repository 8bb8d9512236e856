"""SQL that computes the registered queries independently, for DuckDB."""

from __future__ import annotations

import math

from slotcast.plans.features import SCENARIOS

# fixed values, as in fixed.py: written out again so that the SQL stands on its own
START = "TIMESTAMP '2024-01-23 00:00:00'"
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
          "November", "December"]
WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

CENTS = "CAST(round(value * 100) AS BIGINT)"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def _mean(where: str = "TRUE") -> str:
    return (f"CAST(sum({CENTS}) FILTER (WHERE {where}) AS DOUBLE) / 100.0::DOUBLE"
            f" / nullif(count(*) FILTER (WHERE {where}), 0)")


LOAD = f"load AS (SELECT date_trunc('hour', ts) AS datetime, {_mean()} AS puissance FROM events GROUP BY 1)"

WEATHER = f"""weather AS (
  SELECT date_trunc('hour', ts) - to_hours(CAST(hour(ts) % 3 AS BIGINT)) AS datetime,
         {_mean("event_type = 'view'")} AS temp, {_mean("event_type = 'click'")} AS pression,
         {_mean("event_type = 'signup'")} AS hr, {_mean("event_type = 'purchase'")} AS p_rosee,
         {_mean("event_type = 'error'")} AS visi, {_mean()} AS vt_moy, max(value) AS vt_raf,
         CAST((min(event_id) * 37) % 361 AS DOUBLE) AS vt_dir,
         max(value) FILTER (WHERE event_type = 'purchase' AND value >= 100) AS rr_3h,
         max(value) FILTER (WHERE event_type = 'error' AND value >= 200) AS neige,
         CAST(nullif(count(*) FILTER (WHERE event_type = 'error' AND value >= 100), 0) AS DOUBLE) AS nebul
  FROM events GROUP BY 1)"""

LEVELS = """levels AS (
  SELECT datetime - to_hours(CAST(hour(datetime) % 3 AS BIGINT)) AS datetime,
         max(puissance) FILTER (WHERE hour(datetime) % 3 = 0) AS P0,
         max(puissance) FILTER (WHERE hour(datetime) % 3 = 1) AS P1,
         max(puissance) FILTER (WHERE hour(datetime) % 3 = 2) AS P2
  FROM load GROUP BY 1)"""

# every slot ahead, with or without measures
ASKED = f"""asked AS (SELECT unnest(generate_series({START}, (SELECT max(datetime) FROM weather), INTERVAL 3 HOUR)) AS datetime)"""

SLOTS = "slots AS (SELECT datetime, P0, P1 - P0 AS DP1, P2 - P0 AS DP2, P2 - P1 AS DP12 FROM levels)"


def calendar(t: str) -> str:
    return (f"dayname({t}) AS Weekday, CAST(day({t}) AS INTEGER) AS Day, monthname({t}) AS Month,"
            f" CAST(year({t}) AS INTEGER) AS Year, CAST(hour({t}) AS INTEGER) AS Hour")


def flags(t: str) -> str:
    weekend = f"(dayname({t}) IN ('Saturday', 'Sunday'))"
    holiday = f"(strftime({t}, '%d/%m') IN ('01/01', '01/05', '08/05', '14/07', '15/08', '01/11', '25/12'))"
    summer = f"(month({t}) IN (4, 5, 6, 7, 8, 9, 10))"
    return f"""{weekend} AS f_weekend, CAST({holiday} AND {weekend} AS INTEGER) AS f_ferie,
       CASE WHEN {summer} THEN 'summer' ELSE 'winter' END AS f_season,
       CAST(CASE WHEN {summer} THEN hour({t}) >= 21 ELSE hour({t}) >= 18 END AS INTEGER) AS f_evening,
       CAST(hour({t}) <= 2 AS INTEGER) AS f_midnight,
       CASE WHEN hour({t}) IN (0, 3, 6, 9, 12, 15, 18, 21) THEN 'H' || hour({t}) END AS f_hour"""


def rose(x: str) -> str:
    return (f"CASE WHEN {x} >= 315 THEN 'North' WHEN {x} >= 225 THEN 'West' WHEN {x} >= 135 THEN 'South'"
            f" WHEN {x} >= 45 THEN 'East' WHEN {x} >= 0 THEN 'North' END")


ORDERS_TEXT = """SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%y %Hh%M') AS o_date,
       CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice,
       nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders"""

COPIES = f"""text AS ({ORDERS_TEXT}),
copies AS (SELECT * FROM text UNION ALL SELECT * FROM text WHERE o_totalprice > 250000
           UNION ALL SELECT * FROM text WHERE o_totalprice IS NULL)"""

ORDER_STAMPS = "stamps AS (SELECT o_orderkey, o_orderdate + to_hours(o_custkey % 24) AS datetime FROM orders)"

HOUR_MEANS = f"""means AS (SELECT hour(datetime) AS h, avg(puissance) AS guess FROM load WHERE datetime < {START} GROUP BY 1),
scored AS (SELECT datetime, guess AS puissance, puissance AS reality
           FROM load LEFT JOIN means ON hour(datetime) = h WHERE datetime >= {START})"""


def _whiskers(name: str, value: str) -> str:
    return f"""SELECT '{name}' AS variable, {r6(f'min({value}) FILTER (WHERE {value} >= lo)')} AS whisker_low,
       {r6('min(a)')} AS q1, {r6('min(b)')} AS median, {r6('min(c)')} AS q3,
       {r6(f'max({value}) FILTER (WHERE {value} <= hi)')} AS whisker_high,
       count({value}) FILTER (WHERE {value} < lo OR {value} > hi) AS outliers
FROM v, (SELECT quantile_cont({value}, 0.25) AS a, quantile_cont({value}, 0.5) AS b, quantile_cont({value}, 0.75) AS c,
         a - 1.5 * (c - a) AS lo, c + 1.5 * (c - a) AS hi FROM v)"""


GAPS = """SELECT l_orderkey, l_returnflag, l_linestatus, l_shipdate, l_quantity, l_extendedprice,
       nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax FROM lineitem"""


def _summary(c: str) -> str:
    return f"""SELECT '{c}' AS variable, {r6(f'min({c})')} AS "min", {r6(f'quantile_cont({c}, 0.25)')} AS q1,
       {r6(f'quantile_cont({c}, 0.5)')} AS median, {r6(f'avg({c})')} AS mean, {r6(f'quantile_cont({c}, 0.75)')} AS q3,
       {r6(f'max({c})')} AS "max", {r6(f'stddev_samp({c})')} AS sd, count(*) - count({c}) AS nulls FROM gaps"""


def _null_row(c: str) -> str:
    return f"SELECT '{c}' AS variable, count(*) - count({c}) AS nb_na, avg(CAST({c} IS NULL AS INTEGER)) AS p_na FROM gaps"


def _scaling(by: bool, center_scale: str | None) -> str:
    """Literal two steps: impute with training means, then measure the imputed training rows.
    ``center_scale`` is None, 'same' (by the imputation's groups) or 'global'."""
    keys = ["l_returnflag", "l_linestatus"] if by else []
    group = "GROUP BY " + ", ".join(keys) if keys else ""
    pick = ", ".join(keys) + "," if keys else ""
    match = " AND ".join(f"t.{k} IS NOT DISTINCT FROM m.{k}" for k in keys) or "TRUE"
    means = ", ".join(f"avg({c}) AS m_{c}" for c in MEASURES)
    filled = ", ".join(f"coalesce(t.{c}, m_{c}) AS {c}" for c in MEASURES)
    sql = f"""WITH t AS (SELECT *, CASE WHEN l_shipdate >= TIMESTAMP '2000-07-01' THEN 'test' ELSE 'train' END AS DATA_ FROM ({GAPS})),
m AS (SELECT {pick} {means} FROM t WHERE DATA_ = 'train' {group}),
filled AS (SELECT t.l_orderkey, t.l_returnflag, t.l_linestatus, t.DATA_, {filled} FROM t LEFT JOIN m ON {match})"""
    if center_scale is None:
        out = ", ".join(f"{r6(c)} AS {c}" for c in MEASURES)
        return f"{sql} SELECT l_orderkey, l_returnflag, l_linestatus, DATA_, {out} FROM filled"
    keys = keys if center_scale == "same" else []
    group = "GROUP BY " + ", ".join(keys) if keys else ""
    pick = ", ".join(keys) + "," if keys else ""
    match = " AND ".join(f"f.{k} IS NOT DISTINCT FROM s.{k}" for k in keys) or "TRUE"
    stats = ", ".join(f"avg({c}) AS c_{c}, stddev_samp({c}) AS s_{c}" for c in MEASURES)
    out = ", ".join(
        f"{r6(f'(f.{c} - coalesce(c_{c}, 0)) / coalesce(nullif(s_{c}, 0), 1)')} AS {c}" for c in MEASURES)
    return f"""{sql}, s AS (SELECT {pick} {stats} FROM filled WHERE DATA_ = 'train' {group})
SELECT f.l_orderkey, f.l_returnflag, f.l_linestatus, f.DATA_, {out} FROM filled f LEFT JOIN s ON {match}"""


def _fit_transfer() -> str:
    cols = ["temp", "pression", "vt_moy", "vt_raf", "rr_3h", "nebul"]
    means = ", ".join(f"avg({c}) AS m_{c}" for c in cols)
    sds = ", ".join(f"stddev_samp(coalesce({c}, m_{c})) AS s_{c}" for c in cols)
    out = ", ".join(
        f"{r6(f'(coalesce(t.{c}, m_{c}) - coalesce(m_{c}, 0)) / coalesce(nullif(s_{c}, 0), 1)')} AS {c}" for c in cols)
    return f"""WITH {WEATHER},
t AS (SELECT datetime, dayname(datetime) AS Weekday, CAST(hour(datetime) AS INTEGER) AS Hour, {', '.join(cols)},
             CASE WHEN datetime >= {START} THEN 'test' ELSE 'train' END AS DATA_ FROM weather),
m AS (SELECT Weekday, Hour, {means} FROM t WHERE DATA_ = 'train' GROUP BY 1, 2),
s AS (SELECT t.Weekday, t.Hour, {sds} FROM t JOIN m USING (Weekday, Hour) WHERE DATA_ = 'train' GROUP BY 1, 2)
SELECT t.datetime, t.Weekday, t.Hour, t.DATA_, {out}
FROM t LEFT JOIN m USING (Weekday, Hour) LEFT JOIN s USING (Weekday, Hour)"""


FINAL_NUMBERS = ["temp", "pression", "hr", "p_rosee", "visi", "vt_raf", "rr_3h", "nebul"]


def _cells() -> str:
    """One SELECT for each variable of each set."""
    texts = {"Month", "Weekday", "rose_vt", "f_season"}
    flags_ = {"f_weekend", "f_evening"}
    parts = []
    for number, features in SCENARIOS.items():
        for i, v in enumerate(features.variables):
            value = f"CAST({v} AS INTEGER)" if v in flags_ else v
            text, cell = (v, "CAST(NULL AS DOUBLE)") if v in texts else ("CAST(NULL AS VARCHAR)", f"CAST({value} AS DOUBLE)")
            parts.append(f"SELECT CAST({number} AS INTEGER) AS scenario, datetime, CAST({i} AS INTEGER) AS position, '{v}' AS variable, {text} AS text, {cell} AS number FROM f")
    return f"WITH {WEATHER}, f AS (SELECT *, {calendar('datetime')}, {flags('datetime')}, {rose('vt_dir')} AS rose_vt FROM weather) " + " UNION ALL ".join(parts)


def _formula() -> str:
    return """WITH o AS (SELECT o_orderkey, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS DOUBLE) AS price, nullif(o_orderpriority, '5-LOW') AS priority, o_orderstatus AS status FROM orders),
levels AS (
  SELECT 'priority' AS variable, priority AS level, 1 + row_number() OVER (ORDER BY count(*) DESC, priority) - 1 AS position FROM o WHERE status <> 'P' AND priority IS NOT NULL GROUP BY priority
  UNION ALL
  SELECT 'status', status, (SELECT count(DISTINCT priority) FROM o WHERE status <> 'P') + row_number() OVER (ORDER BY count(*) DESC, status) FROM o WHERE status <> 'P' GROUP BY status)
SELECT o_orderkey, CAST(0 AS INTEGER) AS position, price AS value FROM o
UNION ALL SELECT o_orderkey, CAST(position AS INTEGER), CAST(coalesce(CASE variable WHEN 'priority' THEN priority ELSE status END = level, FALSE) AS DOUBLE) FROM o, levels"""


def _matrix() -> str:
    """Scaled numbers, then month, direction, weekday and season flags, then hour and weekend."""
    means = ", ".join(f"avg({c}) AS m_{c}" for c in FINAL_NUMBERS)
    sds = ", ".join(f"stddev_samp(coalesce({c}, m_{c})) AS s_{c}" for c in FINAL_NUMBERS)
    cells = [f"coalesce((coalesce({c}, m_{c}) - coalesce(m_{c}, 0)) / coalesce(nullif(s_{c}, 0), 1), 0)" for c in FINAL_NUMBERS]
    cells += [f"coalesce(Month = '{v}', FALSE)" for v in MONTHS]
    cells += [f"coalesce(rose_vt = '{v}', FALSE)" for v in ("North", "East", "South", "West")]
    cells += [f"coalesce(Weekday = '{v}', FALSE)" for v in WEEKDAYS]
    cells += [f"coalesce(f_season = '{v}', FALSE)" for v in ("summer", "winter")]
    cells += ["Hour", "f_weekend"]
    rows = " UNION ALL ".join(
        f"SELECT datetime, DATA_, CAST({i} AS INTEGER) AS position, {r6(f'CAST({cell} AS DOUBLE)')} AS value FROM joined"
        for i, cell in enumerate(cells))
    return f"""WITH {WEATHER},
t AS (SELECT *, {calendar('datetime')}, {flags('datetime')}, {rose('vt_dir')} AS rose_vt,
             CASE WHEN datetime >= {START} THEN 'test' ELSE 'train' END AS DATA_ FROM weather),
m AS (SELECT Month, Hour, {means} FROM t WHERE DATA_ = 'train' GROUP BY 1, 2),
s AS (SELECT t.Month, t.Hour, {sds} FROM t JOIN m USING (Month, Hour) WHERE DATA_ = 'train' GROUP BY 1, 2),
joined AS (SELECT * FROM t LEFT JOIN m USING (Month, Hour) LEFT JOIN s USING (Month, Hour))
{rows}"""


def _flag(condition: str, name: str) -> str:
    return f"CAST(coalesce({condition}, FALSE) AS INTEGER) AS \"{name}\""


def _split_hash(seed: str, key: str) -> str:
    return f"CAST('0x' || substr(md5({seed} || '|' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT)"


def _score(name: str, keys: list[str]) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    pick = ", ".join(keys)
    return f"""SELECT '{name}' AS scenario, a.repeat, avg(abs((a.puissance - coalesce(guess, overall)) / a.puissance)) * 100 AS mape
FROM runs a LEFT JOIN (SELECT repeat, {pick}, avg(puissance) AS guess FROM runs WHERE is_train GROUP BY ALL) b
     ON a.repeat = b.repeat AND {on}
     JOIN (SELECT repeat, avg(puissance) AS overall FROM runs WHERE is_train GROUP BY 1) o ON a.repeat = o.repeat
WHERE NOT a.is_train GROUP BY a.repeat"""


def _metrics(strict: bool) -> str:
    whole = "count(reality) = count(*)" if strict else "TRUE"
    return f"""SELECT event_type, count(*) AS n,
       {r6(f'CASE WHEN {whole} THEN sqrt(avg((reality - puissance) ** 2)) END')} AS rmse,
       {r6(f'CASE WHEN {whole} THEN avg(abs((reality - puissance) / nullif(reality, 0))) END')} AS mape,
       {r6(f'CASE WHEN {whole} THEN avg(abs(reality - puissance)) END')} AS mae,
       count(*) FILTER (WHERE reality = 0) AS zero_truths, {str(strict).upper()} AS strict FROM pairs GROUP BY 1"""


SERIES = ["temp", "pression", "hr", "p_rosee", "visi", "vt_moy", "vt_raf", "vt_dir", "rr_3h", "nebul"]

# keys of the groups whose means a tree over the set predicts
GROUPS = {"hour": "hour(datetime)", "weekend": "dayname(datetime) IN ('Saturday', 'Sunday')", "weekday": "dayname(datetime)"}
PREPARATIONS = ["impute_global_scale_global", "impute_group", "impute_group_scale_global", "scale_group"]


def _slot_means(key: str) -> str:
    return f"""means AS (SELECT {key} AS k, avg(P0) AS P0, avg(DP1) AS DP1, avg(DP2) AS DP2
          FROM slots JOIN weather USING (datetime) WHERE P0 IS NOT NULL AND datetime < {START} GROUP BY 1)"""


def _hourly(key: str) -> str:
    return " UNION ALL ".join(
        f"SELECT datetime + to_hours(CAST({k} AS BIGINT)) AS datetime, {v} AS puissance FROM asked JOIN means ON {key} = k"
        for k, v in enumerate(("P0", "P0 + DP1", "P0 + DP2")))


HOURLY_MEANS = f"{_slot_means('hour(datetime)')}, hourly AS ({_hourly('hour(datetime)')})"


def _holdout(key: str, scenario: str, first: int, last: int) -> str:
    """Errors of group means over repeated exact splits of the training slots."""
    return f"""WITH {LOAD}, {LEVELS}, {WEATHER},
train AS (SELECT levels.* FROM levels JOIN weather USING (datetime) WHERE P0 IS NOT NULL AND datetime < {START}),
hashed AS (SELECT *, {key} AS k, {_split_hash('CAST(repeat AS VARCHAR)', 'datetime')} AS hash
           FROM train, (SELECT CAST(unnest(generate_series({first}, {last})) AS INTEGER) AS repeat)),
runs AS (SELECT *, row_number() OVER (PARTITION BY repeat ORDER BY hash, datetime)
         <= floor(0.79 * (SELECT count(*) FROM train)) AS is_train FROM hashed),
means AS (SELECT repeat, k, avg(P0) AS m0, avg(P1 - P0) AS m1, avg(P2 - P0) AS m2 FROM runs WHERE is_train GROUP BY 1, 2),
held AS (SELECT runs.*, m0, m1, m2 FROM runs JOIN means USING (repeat, k) WHERE NOT is_train),
pairs AS (SELECT repeat, m0 AS p, P0 AS y FROM held UNION ALL SELECT repeat, m0 + m1, P1 FROM held
          UNION ALL SELECT repeat, m0 + m2, P2 FROM held)
SELECT '{scenario}' AS scenario, repeat, count(*) AS n, {r6('avg(abs((y - p) / nullif(y, 0))) * 100')} AS mape,
       {r6('sqrt(avg((y - p) ** 2))')} AS rmse, {r6('avg(abs(y - p))')} AS mae FROM pairs GROUP BY repeat"""


def _forecast_errors(key: str, scenario: str) -> str:
    return f"""SELECT * FROM (WITH {LOAD}, {LEVELS}, {SLOTS}, {WEATHER}, {ASKED}, {_slot_means(key)}, hourly AS ({_hourly(key)}),
scored AS (SELECT hourly.datetime, hourly.puissance AS p, load.puissance AS y FROM hourly LEFT JOIN load USING (datetime))
SELECT '{scenario}' AS scenario, count(*) AS n, {r6('avg(abs((y - p) / nullif(y, 0))) * 100')} AS mape, {r6('sqrt(avg((y - p) ** 2))')} AS rmse,
       {r6('avg(abs(y - p))')} AS mae, 'scale_group' AS preparation, count(*) AS hours, min(datetime) AS first_hour FROM scored)"""


def _mixed(source: str, numbers: list[str], keep: str) -> str:
    """Subqueries that mix whole numbers into 64 bits (``h``) with products modulo 2^64."""
    def times(h: str, by: str) -> str:
        return f"CAST((CAST({h} AS UHUGEINT) * CAST({by} AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT)"

    out = f"SELECT {keep}, CAST(0 AS UBIGINT) AS h FROM {source}"
    for x in numbers:
        out = f"SELECT {keep}, CAST((CAST(h AS UHUGEINT) + CAST({x} AS UHUGEINT) + CAST(11400714819323198485 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT) AS h FROM ({out})"
        for shift, by in ((30, "13787848793156543929"), (27, "10723151780598845931")):
            out = f"SELECT {keep}, {times(f'xor(h, h >> {shift})', by)} AS h FROM ({out})"
        out = f"SELECT {keep}, xor(h, h >> 31) AS h FROM ({out})"
    return out


def _bags(source: str, row: str, keep: str) -> str:
    """Poisson(1) counts of a row in a tree, by hash of seed 1, tree and row."""
    edges = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)]
    u = "CAST(h >> 11 AS DOUBLE) * 1.1102230246251565e-16"
    return f"SELECT {keep}, {' + '.join(f'CAST({e!r} <= {u} AS INTEGER)' for e in edges)} AS times FROM ({_mixed(source, ['1', 'tree', row], keep)})"


NUMERICS = ["temp", "pression", "hr", "p_rosee", "visi", "vt_moy", "vt_raf", "vt_dir", "rr_3h"]

ORACLE = {
    "rename_project": "SELECT ts AS datetime, value AS puissance FROM events",
    "time_bound_filter": "SELECT event_id, ts, value FROM events WHERE ts <= TIMESTAMP '2024-01-22 23:00:00'",
    "run_label": """SELECT event_id, strftime(ts, '%Y%m%d_%H%M') || '_' || event_type || '_' || printf('%.3f', value) AS label
FROM events""",
    "csv_roundtrip": ORDERS_TEXT,
    "result_sink": f"""WITH text AS ({ORDERS_TEXT})
SELECT *, '20240101_0300_first_8.161' AS run FROM text
UNION ALL SELECT *, '20240101_0600_second_9.250' AS run FROM text WHERE o_totalprice IS NULL""",
    "parquet_roundtrip": f"""WITH {LOAD},
d AS (SELECT CAST(day(datetime) AS INTEGER) AS day, count(*) AS hours FROM load GROUP BY 1)
SELECT o.*, CAST(day(o_orderdate) AS INTEGER) AS day, d.hours FROM orders o LEFT JOIN d ON day(o_orderdate) = d.day""",
    "dedup_rows": f"WITH {COPIES} SELECT DISTINCT * FROM copies",
    "dedup_counts": f"""WITH {COPIES}, a AS (SELECT count(*) AS rows_in FROM copies),
b AS (SELECT count(*) AS rows_kept FROM (SELECT DISTINCT * FROM copies))
SELECT rows_in, rows_kept, rows_in - rows_kept AS rows_removed FROM a, b""",
    "parse_offset_ts": """SELECT event_id,
  CASE WHEN event_type <> 'signup' THEN date_trunc('second', ts) END AS datetime,
  CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN NULL WHEN 'view' THEN '+01:00' ELSE '+02:00' END AS fuseau,
  CASE WHEN event_type <> 'signup' THEN date_trunc('second', ts)
       - to_hours(CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 1 ELSE 2 END) END AS datetime_utc
FROM events""",
    "parse_dmy_ts": """SELECT o_orderkey, try_strptime(CASE WHEN o_orderstatus = 'P' THEN '32/13/16 00h00'
  ELSE strftime(o_orderdate, '%d/%m/%y %Hh%M') END, '%d/%m/%y %Hh%M') AS datetime FROM orders""",
    "round_hour": "SELECT event_id, date_trunc('hour', ts + INTERVAL 30 MINUTE) AS datetime FROM events",
    "calendar_features": f"""WITH {ORDER_STAMPS} SELECT o_orderkey, datetime, {calendar('datetime')},
  CAST(dayofweek(datetime) + 1 AS INTEGER) AS weekday_rank, CAST(month(datetime) AS INTEGER) AS month_rank,
  strftime(datetime, '%a') AS weekday_short, strftime(datetime, '%b') AS month_short FROM stamps""",
    "flag_features": f"""WITH {ORDER_STAMPS} SELECT o_orderkey, datetime, {flags('datetime')},
  CAST(strftime(datetime, '%d/%m') IN ('01/01', '01/05', '08/05', '14/07', '15/08', '01/11', '25/12')
       OR dayofweek(datetime) IN (0, 6) AS INTEGER) AS f_ferie_any FROM stamps""",
    "direction_bins": f"""WITH d AS (SELECT event_id,
  CASE WHEN event_type <> 'error' THEN CAST(event_id * 37 % 362 - 1 AS DOUBLE) END AS vt_dir FROM events)
SELECT event_id, vt_dir, {rose('vt_dir')} AS rose_vt FROM d""",
    "circular_mean": f"""WITH d AS (SELECT event_type, CASE WHEN value < 90 THEN radians(CAST(event_id * 37 % 361 AS DOUBLE) / 2) END AS a FROM events)
SELECT event_type, {r6('(degrees(atan2(avg(sin(a)), avg(cos(a)))) + 360) % 360')} AS direction, count(a) AS n FROM d GROUP BY 1""",
    "fold_hourly": f"WITH {LOAD}, {LEVELS}, {SLOTS} SELECT * FROM slots",
    "fold_duplicates": """WITH f AS (SELECT date_trunc('hour', ts) AS h, arg_min(value, event_id) AS v FROM events GROUP BY 1),
p AS (SELECT h - to_hours(CAST(hour(h) % 3 AS BIGINT)) AS datetime, max(v) FILTER (WHERE hour(h) % 3 = 0) AS P0,
      max(v) FILTER (WHERE hour(h) % 3 = 1) AS P1, max(v) FILTER (WHERE hour(h) % 3 = 2) AS P2 FROM f GROUP BY 1)
SELECT *, P1 - P0 AS DP1, P2 - P0 AS DP2, P2 - P1 AS DP12 FROM p""",
    "unfold_predictions": f"""WITH {LOAD}, {LEVELS},
h AS (SELECT datetime, P0 AS puissance, P0 AS chained FROM levels
      UNION ALL SELECT datetime + INTERVAL 1 HOUR, P0 + (P1 - P0), P0 + (P1 - P0) FROM levels
      UNION ALL SELECT datetime + INTERVAL 2 HOUR, P0 + (P2 - P0), P0 + (P1 - P0) + (P2 - P1) FROM levels)
SELECT datetime, {r6('puissance')} AS puissance, {r6('chained')} AS chained,
       row_number() OVER (ORDER BY datetime) - 1 AS position FROM h""",
    "unpivot_measures": " UNION ALL ".join(
        f"SELECT l_orderkey, l_linenumber, '{c}' AS variable, {c} AS value FROM lineitem" for c in MEASURES),
    "join_weather_filter": f"""WITH {LOAD}, {LEVELS}, {SLOTS}, {WEATHER}
SELECT slots.*, weather.* EXCLUDE (datetime), {calendar('slots.datetime')}, {flags('slots.datetime')},
       {rose('vt_dir')} AS rose_vt
FROM slots JOIN weather USING (datetime)
WHERE P0 IS NOT NULL AND DP1 IS NOT NULL AND DP2 IS NOT NULL AND DP12 IS NOT NULL""",
    "import_train": f"""WITH {LOAD}, {LEVELS}, {SLOTS}, {WEATHER}
SELECT slots.*, weather.* EXCLUDE (datetime), {calendar('slots.datetime')}, {flags('slots.datetime')},
       {rose('vt_dir')} AS rose_vt
FROM slots JOIN weather USING (datetime)
WHERE P0 IS NOT NULL AND DP1 IS NOT NULL AND DP2 IS NOT NULL AND DP12 IS NOT NULL""",
    "import_ahead": f"""WITH {WEATHER} SELECT *, {calendar('datetime')}, {flags('datetime')}, {rose('vt_dir')} AS rose_vt
FROM weather WHERE datetime <= TIMESTAMP '2024-01-29 23:00:00'""",
    "join_back_left": f"WITH {LOAD}, {WEATHER} SELECT load.*, weather.* EXCLUDE (datetime) FROM load LEFT JOIN weather USING (datetime)",
    "tagged_union": f"""WITH {LOAD} SELECT *, CASE WHEN datetime >= {START} THEN 'test' ELSE 'train' END AS DATA_ FROM load""",
    "positional_attach": f"WITH {LOAD} SELECT datetime, puissance, puissance * 2 + 1 AS reality FROM load",
    "row_error_pct": f"""WITH {LOAD}, {HOUR_MEANS} SELECT datetime, {r6('puissance')} AS puissance, reality,
  {r6('abs(puissance - reality) / nullif(abs(reality), 0) * 100')} AS mape FROM scored""",
    "na_profile": f"""WITH gaps AS (SELECT * REPLACE (nullif(l_linestatus, 'O') AS l_linestatus) FROM ({GAPS})), p AS (
{' UNION ALL '.join(_null_row(c) for c in ['l_orderkey', 'l_returnflag', 'l_linestatus', *MEASURES])})
SELECT variable, nb_na, {r6('p_na')} AS p_na, CAST(row_number() OVER (ORDER BY p_na DESC, variable) AS INTEGER) AS place
FROM p WHERE nb_na >= 1""",
    "table_summary": f"WITH gaps AS ({GAPS}) " + " UNION ALL ".join(_summary(c) for c in MEASURES),
    "boxplot_stats": f"""WITH v AS (SELECT value, CASE WHEN event_type <> 'error' THEN value END AS valid FROM events)
{_whiskers('value', 'value')} UNION ALL {_whiskers('valid', 'valid')}""",
    "boxplot_outliers": """WITH v AS (SELECT value, CASE WHEN event_type <> 'error' THEN value END AS valid FROM events),
a AS (SELECT quantile_cont(value, 0.25) AS p, quantile_cont(value, 0.75) AS q FROM v),
b AS (SELECT quantile_cont(valid, 0.25) AS p, quantile_cont(valid, 0.75) AS q FROM v)
SELECT 'value' AS variable, value, count(*) AS times FROM v, a WHERE value < p - 1.5 * (q - p) OR value > q + 1.5 * (q - p) GROUP BY 2
UNION ALL
SELECT 'valid' AS variable, valid, count(*) AS times FROM v, b WHERE valid < p - 1.5 * (q - p) OR valid > q + 1.5 * (q - p) GROUP BY 2""",
    "boxplot_groups": f"WITH gaps AS ({GAPS}) " + " UNION ALL ".join(
        f"""SELECT l_returnflag, l_linestatus, '{c}' AS variable, count({c}) AS n, {r6(f'quantile_cont({c}, 0.25)')} AS q0,
{r6(f'quantile_cont({c}, 0.5)')} AS q1, {r6(f'quantile_cont({c}, 0.75)')} AS q2 FROM gaps GROUP BY 1, 2""" for c in MEASURES),
    "profile_month_hour": f"""WITH {LOAD} SELECT monthname(datetime) AS Month, CAST(hour(datetime) AS INTEGER) AS Hour,
  count(*) AS n, {r6('avg(puissance)')} AS moy_puiss, {r6('stddev_samp(puissance)')} AS std_puiss FROM load GROUP BY 1, 2""",
    "profile_year_month_hour": f"""WITH {ORDER_STAMPS},
t AS (SELECT datetime, year(datetime) || '-' || strftime(datetime, '%b') AS year_month, strftime(datetime, '%b') AS Month,
      CAST(hour(datetime) AS INTEGER) AS Hour, CAST(round(o_totalprice * 100) AS BIGINT) AS c
      FROM stamps JOIN orders USING (o_orderkey)),
l AS (SELECT year_month, CAST(row_number() OVER (ORDER BY min(datetime), year_month) AS INTEGER) AS level FROM t GROUP BY 1)
SELECT year_month, Month, Hour, count(*) AS n, avg(c) AS moy_puiss, round(stddev_samp(c), 3) AS std_puiss, level
FROM t JOIN l USING (year_month) GROUP BY year_month, Month, Hour, level""",
    "crosstab_stats": "WITH t AS (SELECT dayname(o_orderdate) AS Weekday, monthname(o_orderdate) AS m, "
        "CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders) SELECT Weekday, " + ", ".join(
        f"avg(c) FILTER (WHERE m = '{m}') AS \"{m}_mean\", round(stddev_samp(c) FILTER (WHERE m = '{m}'), 3) AS \"{m}_sd\""
        for m in MONTHS) + " FROM t GROUP BY 1",
    "impute_global": _scaling(False, None),
    "impute_by_group": _scaling(True, None),
    "scale_global": _scaling(False, "same"),
    "scale_by_group": _scaling(True, "same"),
    "impute_group_scale_global": _scaling(True, "global"),
    "scaled_moments": f"""WITH gaps AS ({GAPS}), """ + ", ".join(
        f"f_{c} AS (SELECT coalesce({c}, (SELECT avg({c}) FROM gaps)) AS x FROM gaps), "
        f"z_{c} AS (SELECT (x - (SELECT avg(x) FROM f_{c})) / (SELECT stddev_samp(x) FROM f_{c}) AS z FROM f_{c})"
        for c in MEASURES) + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, {r6('avg(z)')} AS mean, {r6('stddev_samp(z)')} AS sd FROM z_{c}" for c in MEASURES),
    "fit_transfer": _fit_transfer(),
    "feature_matrix": _matrix(),
    "onehot": "SELECT o_orderkey, " + ", ".join(
        [_flag(f"dayname(o_orderdate) = '{d}'", d) for d in WEEKDAYS]
        + [_flag(f"monthname(o_orderdate) = '{m}'", m) for m in MONTHS]
        + [_flag(f"o_orderstatus = '{s}'", s) for s in ("F", "O")]
        + [_flag("dayofweek(o_orderdate) NOT IN (0, 6)", "f_weekend_false"),
           _flag("dayofweek(o_orderdate) IN (0, 6)", "f_weekend_true")]) + " FROM orders",
    "onehot_fit_transfer": "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS Year, "
        "nullif(o_orderstatus, 'P') AS o_orderstatus, " + ", ".join(
        [_flag(f"year(o_orderdate) = {y}", f"Year_{y}") for y in (1995, 1996, 1997, 1998)]
        + [_flag(f"o_orderstatus = '{s}'", f"o_orderstatus_{s}") for s in ("F", "O")])
        + ", CASE WHEN o_orderdate >= TIMESTAMP '1999-01-01' THEN 'test' ELSE 'train' END AS DATA_ FROM orders",
    "scenario_projection": f"""WITH {WEATHER}, f AS (SELECT *, {calendar('datetime')}, {flags('datetime')}, {rose('vt_dir')} AS rose_vt FROM weather)
SELECT datetime, Month, rose_vt, Weekday, f_season, temp, pression, hr, p_rosee, visi, vt_raf, rr_3h, nebul, Hour, f_weekend FROM f""",
    "scenario_cells": _cells(),
    "formula_matrix": _formula(),
    "sparse_onehot": """WITH known AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, row_number() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) - 1 AS place FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderdate < DATE '1998-01-01'))
SELECT l_orderkey, l_linenumber, place AS l_orderkey_index, CAST((SELECT count(*) FROM known) AS INTEGER) AS size FROM lineitem LEFT JOIN known ON k = CAST(l_orderkey AS VARCHAR)""",
    "level_order": """SELECT l_orderkey, CAST(row_number() OVER (ORDER BY min(l_shipdate), l_orderkey) AS INTEGER) AS level FROM lineitem GROUP BY l_orderkey""",
    "csv_line_breaks": """SELECT o_orderkey, o_orderpriority || chr(10) || '"' || o_orderstatus || '";' || chr(10) || chr(10) || o_orderkey AS note, o_totalprice FROM orders""",
    "exact_split": f"""SELECT event_id, value,
  CASE WHEN row_number() OVER (ORDER BY {_split_hash("'7'", 'event_id')}, event_id)
            <= round_even(0.79 * (SELECT count(*) FROM events), 0) THEN 'train' ELSE 'test' END AS DATA_ FROM events""",
    "per_target_rows": f"WITH {LOAD}, {LEVELS}, {SLOTS} " + " UNION ALL ".join(
        f"SELECT datetime, '{t}' AS target, {t} AS label FROM slots WHERE {t} IS NOT NULL" for t in ("P0", "DP1", "DP2")),
    "error_metrics": f"""WITH {LOAD}, {HOUR_MEANS} SELECT dayname(datetime) AS Weekday, count(*) AS n,
  {r6('sqrt(avg((reality - puissance) ** 2))')} AS rmse, {r6('avg(abs((reality - puissance) / nullif(reality, 0)))')} AS mape,
  {r6('avg(abs(reality - puissance))')} AS mae, count(*) FILTER (WHERE reality = 0) AS zero_truths FROM scored GROUP BY 1""",
    "error_metrics_gaps": f"""WITH pairs AS (SELECT event_type, 50.0::DOUBLE AS puissance,
  CASE WHEN event_type = 'view' OR value < 400 THEN floor(value) END AS reality FROM events)
{_metrics(True)} UNION ALL {_metrics(False)}""",
    "leaderboard": f"""WITH {LOAD},
hashed AS (SELECT datetime, puissance, dayname(datetime) AS Weekday, hour(datetime) AS Hour, repeat,
           {_split_hash('CAST(repeat AS VARCHAR)', 'datetime')} AS h FROM load, (SELECT unnest([1, 2, 3]) AS repeat)),
runs AS (SELECT *, row_number() OVER (PARTITION BY repeat ORDER BY h, datetime)
         <= floor(0.79 * (SELECT count(*) FROM load)) AS is_train FROM hashed),
results AS ({_score('hour', ['Hour'])} UNION ALL {_score('weekday', ['Weekday'])}
            UNION ALL {_score('hour of week', ['Weekday', 'Hour'])}),
board AS (SELECT scenario, count(*) AS repeats, min(mape) AS lo, quantile_cont(mape, 0.25) AS q1, median(mape) AS median,
          quantile_cont(mape, 0.75) AS q3, avg(mape) AS mean, max(mape) AS hi FROM results GROUP BY 1)
SELECT scenario, repeats, {r6('lo')} AS "min", {r6('q1')} AS q1, {r6('median')} AS median, {r6('q3')} AS q3,
       {r6('mean')} AS mean, {r6('hi')} AS "max", CAST(row_number() OVER (ORDER BY mean, scenario) AS INTEGER) AS place,
       row_number() OVER (ORDER BY mean, scenario) = 1 AS is_best FROM board""",
    "plot_data_forecast": f"""WITH {LOAD}, {HOUR_MEANS} SELECT datetime, CAST(hour(datetime) AS INTEGER) AS hour,
  strftime(datetime, '%b-%d-(%a)') AS panel, {r6('puissance')} AS puissance, reality FROM scored""",
    "plot_data_series": f"WITH {WEATHER} " + " UNION ALL ".join(
        f"""SELECT CAST(year(datetime) AS INTEGER) AS Year, monthname(datetime) AS Month, CAST(day(datetime) AS INTEGER) AS Day,
CAST(hour(datetime) AS INTEGER) AS Hour, '{c}' AS variable, {c} AS value FROM weather""" for c in SERIES),
    "plot_data_load": f"""WITH {LOAD} SELECT CAST(year(datetime) AS INTEGER) AS Year, monthname(datetime) AS Month,
  CAST(day(datetime) AS INTEGER) AS Day, CAST(hour(datetime) AS INTEGER) AS Hour, puissance FROM load""",
    "gbt_hour_means": f"""WITH {LOAD}, {LEVELS}, {SLOTS}, {WEATHER}, {ASKED}, {HOURLY_MEANS}
SELECT hourly.datetime, {r6('hourly.puissance')} AS puissance, load.puissance AS reality,
       {r6('abs(hourly.puissance - load.puissance) / nullif(abs(load.puissance), 0) * 100')} AS mape
FROM hourly LEFT JOIN load USING (datetime)""",
    "submission_file": f"""WITH {LOAD}, {LEVELS}, {SLOTS}, {WEATHER}, {ASKED}, {HOURLY_MEANS}
SELECT row_number() OVER (ORDER BY datetime) - 1 AS position, {r6('puissance')} AS v FROM hourly""",
    "rf_weekday_means": f"""WITH {LOAD}, {LEVELS}, {SLOTS}, {WEATHER}, {ASKED}, {_slot_means('dayname(datetime)')}
SELECT datetime, {r6('P0')} AS "P0", {r6('DP1')} AS "DP1", {r6('DP2')} AS "DP2"
FROM asked JOIN means ON dayname(datetime) = k""",
    "model_io": f"""WITH {LOAD}, {LEVELS}, {SLOTS}, {WEATHER}, {ASKED}, {_slot_means('hour(datetime)')}
SELECT datetime, {r6('P0')} AS "P0", {r6('DP1')} AS "DP1", {r6('DP2')} AS "DP2"
FROM asked JOIN means ON hour(datetime) = k""",
    "scenario_sweep": " UNION ALL ".join(
        f"SELECT * FROM ({_holdout(k, name, 1, 5)}) CROSS JOIN (SELECT unnest([{', '.join(repr(p) for p in PREPARATIONS)}]) AS preparation)" for name, k in GROUPS.items()),
    "scenario_sweep_means": " UNION ALL ".join(f"SELECT *, 'scale_group' AS preparation FROM ({_holdout(k, name, 0, 69)})" for name, k in GROUPS.items()),
    "forest_bags": f"""SELECT tree, times, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys
FROM ({_bags("(SELECT o_orderkey, CAST(unnest(range(0, 20)) AS INTEGER) AS tree FROM orders)", "o_orderkey", "o_orderkey, tree")}) GROUP BY tree, times""",
    "forest_out_of_bag": f"""WITH {LOAD}, {LEVELS}, {WEATHER},
train AS (SELECT datetime, hour(datetime) AS k, P0, P1 - P0 AS DP1, P2 - P0 AS DP2, CAST(epoch(datetime) AS BIGINT) AS second
          FROM levels JOIN weather USING (datetime) WHERE P0 IS NOT NULL AND datetime < {START}),
dealt AS (SELECT *, CAST(unnest(range(0, 25)) AS INTEGER) AS tree FROM train),
bags AS ({_bags("dealt", "second", "datetime, tree, second")}),
rows AS (SELECT datetime, k, tree, times, target, y FROM (
    SELECT datetime, k, 'P0' AS target, P0 AS y FROM train UNION ALL SELECT datetime, k, 'DP1', DP1 FROM train UNION ALL SELECT datetime, k, 'DP2', DP2 FROM train)
    JOIN bags USING (datetime) WHERE y IS NOT NULL),
sums AS (SELECT target, tree, k, sum(times) AS n, sum(times * y) AS s FROM rows WHERE times > 0 GROUP BY ALL),
cuts AS (SELECT target, tree, k, sum(n) OVER up AS nl, sum(s) OVER up AS sl, sum(n) OVER whole AS n, sum(s) OVER whole AS s FROM sums
         WINDOW up AS (PARTITION BY target, tree ORDER BY k), whole AS (PARTITION BY target, tree)),
gains AS (SELECT *, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n AS gain FROM cuts WHERE nl >= 5 AND n - nl >= 5),
best AS (SELECT * FROM gains WHERE gain > 1e-12 * (gain + s * s / n) QUALIFY row_number() OVER (PARTITION BY target, tree ORDER BY gain DESC, k) = 1),
roots AS (SELECT DISTINCT target, tree, n, s FROM cuts),
unseen AS (SELECT datetime, target, avg(CASE WHEN best.k IS NULL THEN roots.s / roots.n WHEN rows.k <= best.k THEN sl / nl ELSE (best.s - sl) / (best.n - nl) END) AS hat
           FROM rows JOIN roots USING (target, tree) LEFT JOIN best USING (target, tree) WHERE times = 0 GROUP BY ALL)
SELECT train.datetime, {", ".join(f"{r6(f'h_{t}.hat')} AS {t}_hat, {r6(f'abs(train.{t} - h_{t}.hat)')} AS {t}_error" for t in ("P0", "DP1", "DP2"))}
FROM train {" ".join(f"LEFT JOIN unseen h_{t} ON h_{t}.datetime = train.datetime AND h_{t}.target = '{t}'" for t in ("P0", "DP1", "DP2"))}""",
    "repeat_statistics": f"""WITH {LOAD}, {LEVELS}, {WEATHER},
train AS (SELECT weather.* FROM levels JOIN weather USING (datetime) WHERE P0 IS NOT NULL AND datetime < {START}),
hashed AS (SELECT *, CAST(hour(datetime) AS INTEGER) AS Hour, {_split_hash('CAST(repeat AS VARCHAR)', 'datetime')} AS hash
           FROM train, (SELECT CAST(unnest(range(0, 70)) AS INTEGER) AS repeat)),
runs AS (SELECT *, row_number() OVER (PARTITION BY repeat ORDER BY hash, datetime)
         <= floor(0.79 * (SELECT count(*) FROM train)) AS is_train FROM hashed) """ + " UNION ALL ".join(
        f"""SELECT repeat, Hour, count(*) AS n, '{c}' AS variable, round(avg({c}) + 1e-9::DOUBLE, 6) + 0.0 AS mean,
  round(sqrt(var_pop({c}) * count({c}) / nullif(count(*) - 1, 0)) + 1e-9::DOUBLE, 6) + 0.0 AS sd FROM runs WHERE is_train GROUP BY repeat, Hour""" for c in NUMERICS),
    "repeated_holdout": f"SELECT *, 'scale_group' AS preparation FROM ({_holdout(GROUPS['hour'], 'hour', 0, 69)})",
    "forecast_sweep": " UNION ALL ".join(_forecast_errors(k, name) for name, k in GROUPS.items()),
    "holdout_hour_means": f"""WITH {LOAD}, {LEVELS}, {WEATHER},
train AS (SELECT levels.* FROM levels JOIN weather USING (datetime) WHERE P0 IS NOT NULL AND datetime < {START}),
hashed AS (SELECT *, hour(datetime) AS h, {_split_hash('CAST(repeat AS VARCHAR)', 'datetime')} AS hash
           FROM train, (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS repeat)),
runs AS (SELECT *, row_number() OVER (PARTITION BY repeat ORDER BY hash, datetime)
         <= floor(0.79 * (SELECT count(*) FROM train)) AS is_train FROM hashed),
means AS (SELECT repeat, h, avg(P0) AS m0, avg(P1 - P0) AS m1, avg(P2 - P0) AS m2 FROM runs WHERE is_train GROUP BY 1, 2),
held AS (SELECT runs.*, m0, m1, m2 FROM runs JOIN means USING (repeat, h) WHERE NOT is_train),
pairs AS (SELECT repeat, m0 AS p, P0 AS y FROM held UNION ALL SELECT repeat, m0 + m1, P1 FROM held
          UNION ALL SELECT repeat, m0 + m2, P2 FROM held)
SELECT 'hour means' AS scenario, repeat, count(*) AS n, {r6('avg(abs((y - p) / nullif(y, 0))) * 100')} AS mape,
       {r6('sqrt(avg((y - p) ** 2))')} AS rmse, {r6('avg(abs(y - p))')} AS mae FROM pairs GROUP BY repeat""",
}
