from datetime import datetime

from pyspark.sql import functions as F

from slotcast.operators import position, profile
from slotcast.plans.build import build_tables, read_load


def stamp(day, hour):
    return f"{day:02d}/03/16 {hour:02d}h00"


def write_inputs(folder):
    """Two days around the March change of clocks: no row at 02:00 on the 27th, some stamps a
    second early, one line twice, one bad stamp."""
    load = ["Date;Puissance"]
    for day in (26, 27):
        for hour in range(24):
            if (day, hour) != (27, 2):
                load.append(f"2016-03-{day}T{hour:02d}:00:00+0{1 if day == 26 else 2}:00;{100 * day + hour}.5")
    load[3] = load[3].replace("T02:00:00", "T01:59:59")
    load += [load[5], "not a stamp;7"]
    weather = [";".join(["Date UTC", *"abcdefghijk"])]
    for day in (26, 27):
        for hour in range(0, 24, 3):
            weather.append(";".join([stamp(day, hour), *[str(day + i) for i in range(7)], "350", "", "0", "" if hour else "3"]))
    weather.append(weather[1])
    paths = []
    for name, lines in (("load", load), ("weather", weather), ("ahead", weather)):
        path = folder / f"{name}.csv"
        path.write_text("\r".join(lines) + "\r")
        paths.append(str(path))
    return paths


def test_files_to_tables(spark, tmp_path):
    paths = write_inputs(tmp_path)
    tables = build_tables(spark, *paths, str(tmp_path / "tables"), forecast_end="2016-03-26 23:00:00")
    load = {r["datetime"]: r for r in tables["conso_train"].collect()}
    assert len(load) == 48 and None in load
    assert load[datetime(2016, 3, 26, 2)]["puissance"] == 2602.5
    assert load[datetime(2016, 3, 26, 2)]["fuseau"] == "+01:00"
    assert tables["meteo_train"].count() == 16 and tables["meteo_prev"].count() == 17
    train = {r["datetime"]: r for r in tables["data_train"].collect()}
    assert len(train) == 15 and datetime(2016, 3, 27) not in train
    first = train[datetime(2016, 3, 26)]
    assert (first["P0"], first["DP1"], first["DP2"], first["DP12"]) == (2600.5, 1.0, 2.0, 1.0)
    assert (first["rose_vt"], first["Weekday"], first["Month"], first["rr_3h"], first["nebul"]) == (
        "North", "Saturday", "March", None, 3.0)
    assert tables["data_prev"].count() == 9


def test_load_in_utc(spark, tmp_path):
    path = write_inputs(tmp_path)[0]
    utc = {r["puissance"]: r["datetime"] for r in read_load(spark, path, align="utc").collect()}
    assert utc[2600.5] == datetime(2016, 3, 25, 23) and utc[2700.5] == datetime(2016, 3, 26, 22)


def test_positions_over_many_files(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(3000).select(
            F.timestamp_seconds(F.pmod(F.col("id") * 7919, F.lit(3000)) * 40).alias("datetime")).repartition(5)
        out = position.with_position(df, ties=[])
        assert out.select("datetime").inputFiles() and len(out.inputFiles()) > 1
        assert out.filter(F.unix_timestamp("datetime") != F.col("position") * 40).count() == 0
        assert out.count() == 3000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_outliers_are_listed(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 50, 50, -40]] + [(None,)], "x double")
    assert sorted(map(tuple, profile.box_outliers(df, ["x"]).collect())) == [("x", -40.0, 1), ("x", 50.0, 2)]
    levels = spark.createDataFrame([("b", 2), ("a", 1), ("c", 3), ("b", 9)], "name string, datetime int")
    assert {r["name"]: r["level"] for r in profile.first_seen_rank(levels, "name").collect()} == {"a": 1, "b": 2, "c": 3}
