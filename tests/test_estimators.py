import random

import pytest
from pyspark.ml import Pipeline, PipelineModel

from tidewake.operators import models
from tidewake.operators.estimators import Behaviour, FramedFeatures, Whiten
from tidewake.plans import config

ACC = ["AccX", "AccY", "AccZ"]


@pytest.fixture(scope="module")
def frames(spark):
    rng, rows = random.Random(5), []
    for clip in range(2):
        for t in range(120):
            y = 1 + (t // 40) % 2
            rows.append((f"c{clip}", t, clip, y if t % 6 else 0, *(rng.gauss(0, 0.2 if y == 1 else 3.0) for _ in ACC)))
    return spark.createDataFrame(rows, "clip_id string, t long, individual_id int, label int, AccX double, AccY double, AccZ double").cache()


@pytest.mark.parametrize(("name", "settings"), [("hmm", {"temporal_window_samples": 60, "N_iters": 4}), ("dt", {"max_depth": 4})])
def test_a_pipeline_is_saved_and_loaded_whole(frames, tmp_path, name, settings):
    stages = [FramedFeatures(channels=ACC, half=3), Whiten(components=4), Behaviour(model=name, clusters=2, settings=settings)]
    fitted = Pipeline(stages=stages).fit(frames)
    out = {(r.clip_id, r.t): (r.label, r.pred) for r in fitted.transform(frames).collect()}
    assert len(out) == 240 and {len(r.features) for r in fitted.transform(frames).take(3)} == {4}
    known = [(y, p) for y, p in out.values() if y]
    agree = max(sum(y == p for y, p in known), sum((y == 1) == (p == k) for y, p in known for k in (0,)), sum((y == 1) == (p == 1) for y, p in known)) / len(known)
    assert agree > 0.9
    fitted.write().overwrite().save(str(tmp_path / "fitted"))
    again = PipelineModel.load(str(tmp_path / "fitted")).transform(frames)
    assert {(r.clip_id, r.t): (r.label, r.pred) for r in again.collect()} == out
    Pipeline(stages=stages).write().overwrite().save(str(tmp_path / "plan"))
    assert Pipeline.load(str(tmp_path / "plan")).getStages()[2].getOrDefault("model") == name


class Constant(models.BehaviourModel):
    def predict(self, rows):
        from pyspark.sql import functions as F

        return rows.withColumn("pred", F.lit(int(self.settings["value"])))


def test_models_of_ones_own_have_defaults_and_grids(frames):
    models.register("constant", Constant, {"value": 3, "other": 1}, lambda dataset: {"value": [1, 2] if dataset == "HAR" else [1]}, labels=False)
    full = config.with_defaults({"model": "constant", "model_config": {"other": 2}})
    assert full["model_config"] == {"value": 3, "other": 2} and full["unsupervised"]
    assert [r["model_config"]["value"] for r in config.sweep("constant", "HAR", "d", "o", no_cutoff=True)] == [1, 2]
    fitted = Behaviour(model="constant", clusters=4, settings={"value": 3}).fit(frames)
    assert {r.pred for r in fitted.transform(frames).collect()} == {3}
