import pytest

from slotcast.operators import sizing
from slotcast.operators.encode import SparseOneHot
from slotcast.operators.levels import levels_in_order_seen, sorted_levels


def listed(dictionary):
    rows = dictionary.table.orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(dictionary.levels))
    return [r["level"] for r in rows]


def test_many_levels_in_their_order(spark):
    df = spark.range(30_000).selectExpr("(id * 7919) % 10007 AS k", "cast((id * 7919) % 10007 AS string) AS t", "id AS time").repartition(6)
    assert listed(sorted_levels(df, "k")) == list(range(10_007))
    assert listed(sorted_levels(df, "k", as_text=True)) == listed(sorted_levels(df, "t")) == sorted(map(str, range(10_007)))
    assert listed(levels_in_order_seen(df, "k", "time")) == [i * 7919 % 10_007 for i in range(10_007)]


def test_ties_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), (None, 0), ("c", None), ("c", 5), ("d", None), ("a", 9)], "`my.k` string, t int")
    assert listed(levels_in_order_seen(df, "my.k", "t")) == ["d", "a", "b", "c"] and listed(sorted_levels(df, "my.k")) == ["a", "b", "c", "d"]
    assert listed(sorted_levels(df.limit(0), "my.k")) == [] and listed(levels_in_order_seen(df.where("`my.k` IS NULL"), "my.k", "t")) == []


@pytest.mark.parametrize("limit", [None, 0])
def test_index_with_and_without_a_broadcast(spark, plan, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(sizing, "BROADCAST_ROWS", limit)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        known = sorted_levels(spark.range(0, 1000, 2).selectExpr("cast(id AS string) AS k"), "k")
        rows = spark.createDataFrame([("10", 1), ("11", 2), (None, 3), ("998", 4)], "k string, index int")
        out = known.index(rows, "k", "place")
        assert ("BroadcastHashJoin" in plan(out)) == (limit is None)
        order = sorted(str(i) for i in range(0, 1000, 2))
        assert sorted((r["index"], r["place"]) for r in out.collect()) == [(1, order.index("10")), (2, None), (3, None), (4, order.index("998"))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sparse_vectors_of_no_levels(spark):
    df = spark.createDataFrame([(None, 1)], "c string, row int")
    assert [r["c_vector"].indices.tolist() for r in SparseOneHot(["c"]).fit(df).transform(df).collect()] == [[]]
