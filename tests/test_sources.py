from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotcast import fixed
from slotcast.functions.stamps import parse_day_first_stamp
from slotcast.operators.clean import until
from slotcast.operators.position import read_positions
from slotcast.operators.profile import null_profile
from slotcast.session import fresh_path, shared_dir
from slotcast.sources.delimited import read_delimited, read_results, write_delimited, write_result
from slotcast.sources.naming import job_name, run_label
from slotcast.sources.snapshots import load_tables, save_tables

WEATHER = T.StructType(
    [T.StructField("datetime", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in fixed.WEATHER_COLUMNS[1:]])


def weather_file(tmp_path):
    """A byte-order mark, carriage returns only, a garbled header, empty cells."""
    header = "Date UTC;T \xc2;P;HR;Pr;Visi;Vm;Vr;Vd;RR;Neige;Nebul"
    lines = [header]
    for k in range(9):
        cells = [f"{13 + k // 8:02d}/09/16 {3 * (k % 8):02d}h00", "18.3", "1009", "97", "17.8", "9", "12.964", "20.372",
                 "360", "" if k % 2 else "0.2", "", "NA" if k == 3 else "7"]
        lines.append(";".join(cells))
    path = tmp_path / "weather.csv"
    path.write_bytes(b"\xef\xbb\xbf" + "\r".join(lines).encode("latin-1") + b"\r")
    return str(path)


def test_carriage_return_file_with_mark_and_gaps(spark, tmp_path):
    raw = read_delimited(spark, weather_file(tmp_path), WEATHER)
    df = raw.withColumn("datetime", parse_day_first_stamp(F.col("datetime")))
    assert df.count() == 9 and df.filter("datetime IS NULL").count() == 0
    assert until(df, "2016-09-13 21:00:00").count() == 8
    gaps = {r["variable"]: r["nb_na"] for r in null_profile(df).collect()}
    assert gaps == {"neige": 9, "rr_3h": 4, "nebul": 1}
    assert df.select("vt_moy", "vt_dir").first() == (12.964, 360.0)


def test_decimal_comma_round_trip(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("n", T.IntegerType())])
    rows = [("a;b", 1.5, 1), ('say "hi"', -2.25e10, None), ("1,5", None, 3), (None, 0.1, 4)]
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "out")
    write_delimited(df, path)
    text = "\n".join(r["value"] for r in spark.read.text(path).collect())
    assert "1,5" in text and "NA" in text and "1.5" not in text
    back = read_delimited(spark, path, schema, decimal=",")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


def test_cells_that_do_not_fit_are_null(spark, tmp_path):
    path = tmp_path / "odd.csv"
    path.write_text("h1;h2\nx;1.5\n7; 2 \n;\n")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DoubleType())])
    out = read_delimited(spark, str(path), schema)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(None, 1.5), (7, 2.0), (None, None)], key=str)


def test_results_keep_their_run_label(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("x", T.DoubleType())])
    base = str(tmp_path / "results")
    first = write_result(spark.createDataFrame([("a", 1.5), ("b", None)], schema), base, "20160901_0300_job_8.161")
    write_result(spark.createDataFrame([("c", 2.0)], schema), base, "20160902_0300_job_9.000")
    assert "NA" not in "".join(r["value"] for r in spark.read.text(first).collect())
    out = sorted(map(tuple, read_results(spark, base, schema).collect()), key=str)
    assert out == [("a", 1.5, "20160901_0300_job_8.161"), ("b", None, "20160901_0300_job_8.161"),
                   ("c", 2.0, "20160902_0300_job_9.000")]


def test_run_labels(spark):
    row = spark.range(1).select(
        run_label(F.lit("2016-09-20 23:05:00").cast("timestamp"), F.lit("a/b/final.py"), F.lit(8.16093)).alias("label"),
        job_name(F.lit("bare")).alias("none")).first()
    assert row["label"] == "20160920_2305_final_8.161" and row["none"] is None


def test_named_tables(spark, tmp_path):
    save_tables({"a": spark.range(3), "b": spark.range(5)}, str(tmp_path / "snap"))
    tables = load_tables(spark, str(tmp_path / "snap"), ["a", "b"])
    assert (tables["a"].count(), tables["b"].count()) == (3, 5)


def test_line_positions_over_files_and_blocks(spark, tmp_path):
    folder = tmp_path / "vector"
    folder.mkdir()
    counter = 0
    for part, rows in enumerate((500, 3, 2000)):
        lines = [f"{counter + i}.5" for i in range(rows)]
        (folder / f"part-{part:05d}.csv").write_text("\n".join(lines) + "\n")
        counter += rows
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        out = read_positions(spark, str(folder), "v double")
        rows = out.collect()
        blocks = spark.read.text(str(folder)).select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert blocks > 5
    assert len(rows) == counter
    assert all(r["v"] == r["position"] + 0.5 for r in rows)


def test_shared_folder_follows_the_session(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_dir(spark) == named
    assert fresh_path(spark, "x").startswith(named) and fresh_path(spark, "x") != fresh_path(spark, "x")


def test_quotes_line_breaks_and_decimals(spark, tmp_path):
    from decimal import Decimal

    path = str(tmp_path / "quoted")
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("x", T.DecimalType(8, 2)), T.StructField("y", T.DoubleType())])
    rows = [('a "b" c', Decimal("1.25"), 0.5), ('"', Decimal("-3.00"), None), ("two\nlines; here", Decimal("0.10"), 2.0), (None, None, 1.0)]
    write_delimited(spark.createDataFrame(rows, schema), path)
    text = spark.read.text(path).collect()
    assert any(r[0] == '"a ""b"" c";1,25;0,5' for r in text)
    back = read_delimited(spark, path, schema, decimal=",", line_breaks=True).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(rows, key=repr)


def test_results_are_sorted_by_time(spark, tmp_path):
    df = spark.range(2000).select(F.timestamp_seconds(F.pmod(F.col("id") * 7919, F.lit(2000)) * 3600).alias("datetime"), F.col("id").cast("double").alias("v")).repartition(5)
    path = write_result(df, str(tmp_path / "runs"), "one")
    stamps = [r[0] for r in spark.read.option("header", True).option("sep", ";").csv(path).select("datetime").collect()]
    assert stamps == sorted(stamps) and len(stamps) == 2000
