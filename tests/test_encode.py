import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from slotcast.operators.encode import OneHot, SparseOneHot


@pytest.fixture(scope="module")
def many(spark):
    return spark.range(5000).select(F.concat(F.lit("v"), F.lpad("id", 4, "0")).alias("c"), (F.col("id") % 3).cast("string").alias("d"))


def test_five_thousand_levels_as_columns(many):
    model = OneHot(["c"]).fit(many)
    assert len(model.columns) == 5000 and model.columns[:2] == ["v0000", "v0001"] and model.columns[-1] == "v4999"


def test_five_thousand_levels_as_sparse_vectors(spark, many):
    model = SparseOneHot(["c", "d"]).fit(many)
    assert len(model.levels["c"]) == 5000 and model.levels["d"] == ["0", "1", "2"]
    asked = spark.createDataFrame([("v0042", "2", 1), (None, "0", 2), ("new", None, 3)], "c string, d string, row int")
    out = model.transform(asked).orderBy("row").collect()
    assert [r.row for r in out] == [1, 2, 3] and out[0].asDict().keys() == {"row", "c_vector", "d_vector"}
    assert [list(map(int, r["c_vector"].indices)) for r in out] == [[42], [], []] and out[0]["c_vector"].size == 5000
    d = model.transform(asked).select("row", vector_to_array("d_vector").alias("v")).orderBy("row").collect()
    assert [r["v"] for r in d] == [[0.0, 0.0, 1.0], [1.0, 0.0, 0.0], [0.0, 0.0, 0.0]]
