from pyspark.sql import functions as F

from slotcast.session import TIDY, materialise


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(blocks.size()) if (name := blocks.apply(k).getName()).startswith("shuffle_")}


def test_shuffle_files_go_with_the_end_of_a_write(spark):
    before = shuffle_files(spark)
    frame = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    table = materialise(frame)
    for _ in range(50):
        if not (left := shuffle_files(spark) - before):
            break
        spark.range(1).count()
    assert not left
    assert sorted(table.collect()) == sorted(materialise(frame).collect()) == sorted(frame.collect())


def test_the_sessions_own_setting_comes_back(spark):
    materialise(spark.range(3))
    assert spark.conf.get(TIDY, None) in (None, "false")
    for own in ("true", "false"):
        spark.conf.set(TIDY, own)
        materialise(spark.range(3))
        assert spark.conf.get(TIDY) == own
    spark.conf.unset(TIDY)
    try:
        materialise(spark.range(3).select(F.raise_error(F.lit("stop")).alias("x")))
    except Exception:
        pass
    assert spark.conf.get(TIDY, None) in (None, "false")
