import glob

import pytest

import __spark_entry__ as entry
from check_oracle import both_results, database

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not glob.glob(f"{FOLDER}/*.parquet"), reason="driver tables are not here")


@pytest.fixture(scope="module")
def db():
    return database(FOLDER)


@needs_data
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    mine, theirs = both_results(spark, db, FOLDER, name)
    assert mine[1] == theirs[1]
    assert mine[0] == theirs[0]


@needs_data
def test_entry_forecasts_the_horizon(spark):
    out = entry.entry(spark)
    assert set(out.columns) == {"datetime", "puissance", "reality", "mape"}
    rows = out.collect()
    assert len(rows) == 192 and all(r["puissance"] is not None for r in rows)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", ["fold_hourly", "scale_by_group", "exact_split", "join_weather_filter", "dedup_rows", "table_summary"])
def test_no_cartesian_plans(spark, plan, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "Cartesian" not in text and "NestedLoop" not in text


@needs_data
def test_scans_read_only_what_is_needed(spark, plan):
    text = plan(entry.queries()["time_bound_filter"](spark, FOLDER))
    assert "LessThanOrEqual(ts," in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,value:double>" in text
