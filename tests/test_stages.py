import pytest
from pyspark.ml import PipelineModel

from slotcast.plans.features import PREPARATIONS, FeatureSet, prepare
from slotcast.plans.models import Boosting, as_doubles, fit_targets
from slotcast.plans.stages import fit_pipeline
from tests.test_trees import slots

SET = FeatureSet(["Month"], ["temp", "rr_3h"], ["Hour"])


@pytest.mark.parametrize("preparation", PREPARATIONS)
def test_a_loaded_pipeline_takes_raw_slots(spark, tmp_path, preparation):
    """Scaler statistics, levels and models come back from the folder alone, and predict as models fitted step by step."""
    data, learner = slots(spark), Boosting(rounds=2, step=0.5, depth=4)
    train, asked = data.where("datetime < '2023-12-10'"), data.where("datetime >= '2023-12-10'").drop("P0", "P1", "P2", "DP1", "DP2")
    model = fit_pipeline(train, SET, learner, preparation)
    model.write().overwrite().save(f"{tmp_path}/model")
    again = PipelineModel.load(f"{tmp_path}/model")
    got = {r["datetime"]: (r["P0_hat"], r["DP1_hat"], r["DP2_hat"]) for r in again.transform(asked).collect()}
    assert got == {r["datetime"]: (r["P0_hat"], r["DP1_hat"], r["DP2_hat"]) for r in model.transform(asked).collect()} and len(got) > 20
    ready, wanted, columns = prepare(train, asked, SET, preparation)
    steps = fit_targets(as_doubles(ready, columns), columns, ["P0", "DP1", "DP2"], learner)
    want = {r["datetime"]: (r["P0"], r["DP1"], r["DP2"]) for r in steps.predict(as_doubles(wanted, columns)).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], want[k]))
    assert again.stages[0].uid == model.stages[0].uid
