from pyspark.sql import functions as F

from slotcast.llm.membership import told_apart
from slotcast.session import materialise


def test_named_rows_are_listed_and_few_others(spark, plan):
    rows = materialise(spark.range(20_000).select(F.col("id").alias("k"), F.repeat(F.lit("t"), 50).alias("text")))
    named = materialise(spark.range(0, 20_000, 9).select("id"))
    listed, others = told_apart(rows, F.col("k"), named)
    assert listed.columns == others.columns == ["k", "text"]
    assert "Exchange hashpartitioning" not in plan(listed) + plan(others)
    a, b = ([r.k for r in side.collect()] for side in (listed, others))
    assert sorted(a + b) == list(range(20_000))
    assert set(range(0, 20_000, 9)) <= set(a) and len(a) < 2_223 + 200


def test_empty_lists_missing_keys_and_repeats(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (2, "c")], "k long, text string")
    for named, least in (([], 0), ([2, 2], 2)):
        listed, others = told_apart(rows, F.col("k"), materialise(spark.createDataFrame([(n,) for n in named], "id long")))
        a, b = listed.collect(), others.collect()
        assert len(a) + len(b) == 4 and len(a) >= least and not {r.k for r in b} & set(named)
