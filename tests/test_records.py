import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from slotcast.sources.delimited import read_delimited

SCHEMA = StructType([StructField("id", LongType()), StructField("text", StringType()), StructField("more", StringType())])


def quoted(cell):
    return '"' + cell.replace('"', '""') + '"'


def written(path, rows, end="\n", header=True):
    with open(path, "w", newline="") as out:
        if header:
            out.write("id;text;more" + end)
        for i, a, b in rows:
            out.write(f"{i};{quoted(a) if a is not None else ''};{b if b is not None else ''}{end}")


def made(n, seed):
    source = random.Random(seed)
    rows = []
    for i in range(n):
        parts = [source.choice(["word", 'a "quoted" one', "semi;colon", "é", "", '"', "x" * 40]) for _ in range(source.randrange(6))]
        rows.append((i, source.choice([" ", "\n", "\n\n"]).join(parts) or None, source.choice(["m", None, "plain"])))
    return rows


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", 997)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("header", [True, False])
def test_files_of_many_blocks_equal_the_one_task_reader(spark, tmp_path, small_blocks, header):
    """Several files, each read by many tasks, with cells that span lines and blocks, against a reader that never cuts files."""
    for k in range(3):
        written(f"{tmp_path}/part-{k}.csv", made(300, k), header=header)
    one = spark.read.schema("id string, text string, more string").option("sep", ";").option("header", header).option("quote", '"').option("escape", '"').option("multiLine", True).option("nullValue", "").csv(str(tmp_path))
    got = read_delimited(spark, str(tmp_path), SCHEMA, header=header, line_breaks=True)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 30
    want = sorted(((int(r.id), r.text if r.text is None or r.text.strip(" ") else None, r.more) for r in one.collect()), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) == 900


def test_one_cell_over_many_blocks(spark, tmp_path, small_blocks):
    long = "\n".join(f"line {i} of one cell" for i in range(900))
    written(f"{tmp_path}/a.csv", [(1, "first", "m"), (2, long, "m"), (3, "after\nit", None)])
    got = read_delimited(spark, f"{tmp_path}/a.csv", SCHEMA, line_breaks=True).collect()
    assert sorted(map(tuple, got)) == [(1, "first", "m"), (2, long, "m"), (3, "after\nit", None)]


def test_line_ends_blank_lines_and_empty_files(spark, tmp_path):
    written(f"{tmp_path}/a.csv", [(1, "x\r\ny", "m"), (2, None, "n")], end="\r\n")
    (tmp_path / "b.csv").write_text('id;text;more\n\n5;"p\n\nq";z\n\n')
    (tmp_path / "c.csv").write_text("id;text;more\n")
    (tmp_path / "d.csv").write_text("")
    got = read_delimited(spark, str(tmp_path), SCHEMA, line_breaks=True).collect()
    assert sorted(map(tuple, got)) == [(1, "x\ny", "m"), (2, None, "n"), (5, "p\n\nq", "z")]


def test_an_open_quote_takes_the_rest_of_its_file_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;text;more\n1;a;m\n2;"open\n3;b;m\n')
    (tmp_path / "b.csv").write_text("id;text;more\n4;c;m\n")
    got = {r.id: r.text for r in read_delimited(spark, str(tmp_path), SCHEMA, line_breaks=True).collect()}
    assert got.keys() == {1, 2, 4} and got[2].startswith("open\n3;b;m") and got[4] == "c"


def test_partition_columns_are_carried(spark, tmp_path):
    for run in ("r1", "r2"):
        (tmp_path / f"run={run}").mkdir()
        written(f"{tmp_path}/run={run}/x.csv", [(1, f"in\n{run}", "m")])
    got = read_delimited(spark, str(tmp_path), SCHEMA, line_breaks=True, carried=("run",))
    assert got.columns == ["id", "text", "more", "run"] and sorted((r.text, r.run) for r in got.collect()) == [("in\nr1", "r1"), ("in\nr2", "r2")]
