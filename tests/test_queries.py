import os

import pytest
from compare import differences

from tidewake import queries as q

SF = "/root/testdata/sf0.001"
SQL = q.oracle_sql()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, name):
    assert differences(q.queries()[name](spark, SF), SQL[name], SF) == ""


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["feature_vectors", "cwt_magnitude", "model_random"])
def test_queries_without_sql_run(spark, name):
    assert q.queries()[name](spark, SF).count() > 0


def test_one_exchange_for_all_frame_features(spark):
    from tidewake.operators import features

    f = spark.createDataFrame([("a", 0, 1.0)], "clip_id string, t long, x double")
    plan = features.channel_features(f, ["x"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_models_take_all_rows_with_default_settings(spark, monkeypatch):
    from pyspark.ml.linalg import Vectors

    v = spark.createDataFrame([("a", t, 1, Vectors.dense([0.0])) for t in (0, 999_999, 1_000_000, 5_000_000)], ["clip_id", "t", "label", "features"])
    monkeypatch.setattr(q, "vectors", lambda spark, d: v)
    assert q.model_random(spark, SF).count() == 4
    used, make = [], q.models.model
    monkeypatch.setattr(q.models, "model", lambda name, clusters, seed, **settings: used.append(settings) or make("random", clusters, seed))
    for name in ("kmeans", "gmm", "random_forest", "decision_tree", "svm"):
        assert q.queries()[f"model_{name}"](spark, SF).count() == 4
    assert not {"n_init", "max_iter", "n_estimators", "max_samples", "max_depth"} & {k for s in used for k in s}
