import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tidewake.operators import losses, models


@pytest.mark.parametrize(("half", "part"), [(0, 100), (2, 100), (5, 7), (30, 9)])
def test_information_of_neighbouring_assignments(spark, half, part):
    rng = np.random.default_rng(half)
    clips = {"a": rng.dirichlet(np.ones(3), 40), "b": rng.dirichlet(np.ones(3) / 3, 13), "c": rng.dirichlet(np.ones(3), 1)}
    p = np.zeros((3, 3))
    for x in clips.values():
        for s in range(len(x)):
            for r in range(max(0, s - half), min(len(x), s + half + 1)):
                p += np.outer(x[r], x[s])
    p = p / p.sum()
    p = (p + p.T) / 2
    m = p.sum(1)
    d = spark.createDataFrame([(c, t, v.tolist()) for c, x in clips.items() for t, v in enumerate(x)], "clip_id string, t long, probs array<double>")
    got = {(r.i, r.j): r.value for r in losses.joint(d, half, part=part).collect()}
    assert all(abs(got[i, j] - p[i, j]) < 1e-12 for i in range(3) for j in range(3))
    r = losses.information_loss(d, half, weight=1.5, part=part).first()
    assert r.loss == pytest.approx((-p * (np.log(p) - 1.5 * np.log(m)[:, None] - 1.5 * np.log(m)[None])).sum())
    assert r.loss_plain == pytest.approx(-(p * np.log(p / np.outer(m, m))).sum())


def test_classes_without_rows(spark):
    d = spark.createDataFrame([("a", t, [1.0, 0.0]) for t in range(5)], "clip_id string, t long, probs array<double>")
    assert abs(losses.information_loss(d, 1).first().loss) < 1e-12
    assert losses.joint(d.where("t < 0"), 1).count() == 0


def test_nuclear_term_and_divergence(spark):
    rng = np.random.default_rng(1)
    h, v = rng.normal(size=(50, 4)), rng.normal(size=(50, 4))
    d = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(h, v, strict=True)], "latent array<double>, logvar array<double>").repartition(5)
    every = np.linalg.svd(h @ h.T / 50)[1]
    assert losses.nuclear_loss(d, 3, 0.1) == pytest.approx(0.1 * np.sqrt(every[:3]).sum())
    assert losses.nuclear_loss(d, 40) == pytest.approx(np.sqrt(every[:4]).sum()) and losses.nuclear_loss(d.limit(0), 3) == 0
    assert losses.divergence(d, "latent").first().loss == pytest.approx(-0.5 * (1 + v - h**2 - np.exp(v)).mean())


def test_mini_batches_come_near_batch_k_means(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(loc=5 * k, size=(200, 2)) for k in range(3)])
    rows = spark.createDataFrame([(f"c{k % 4}", k, Vectors.dense(v)) for k, v in enumerate(x)], ["clip_id", "t", "features"]).repartition(3)
    m = models.model("minibatch_kmeans", 3, 0, batch_size=200, patience=10, max_iter=8).fit(rows)
    cost = lambda m: sum(((r.features.toArray() - m[r.pred]) ** 2).sum() for r in out.collect())
    out = m.predict(rows)
    mini = cost(m.centres)
    assert out.count() == 600 and 3 <= len(m.inertias) <= 24 and m.diagnostics(spark)["inertia"].count() == len(m.inertias)
    whole = models.model("kmeans", 3, 0, n_init=2, max_iter=20, whiten=False).fit(rows)
    out = whole.predict(rows)
    assert mini < 1.02 * cost(whole.fitted.clusterCenters())
    m.save(str(tmp_path / "m"))
    assert np.array_equal(models.load(str(tmp_path / "m")).centres, m.centres)
    with pytest.raises(ValueError, match="no rows"):
        models.model("minibatch_kmeans", 3).fit(rows.limit(0))


def test_steps_run_on_their_batch_alone(spark):
    """Each row is in one batch an epoch, a step has a task for each of its batch's partitions, and its sums are those of the batch's rows."""
    from pyspark.sql import functions as F

    x = spark.range(5000).selectExpr("id % 7 AS clip_id", "id AS t", "array(cast(id AS double), cast(id % 3 AS double)) AS x")
    m = models.model("minibatch_kmeans", 2, 0)
    m.centres, m.seed = np.array([[0.0, 0.0], [5000.0, 1.0]]), 0
    dealt = m._dealt(x, 0, 5, 2)
    assert dealt.getNumPartitions() == 10
    seen = 0
    for b in range(5):
        own = np.array([r.x for r in x.where(F.pmod(F.xxhash64(F.lit(1), "clip_id", "t"), F.lit(5)) == b).select("x").collect()])
        near, d = models._nearest(own, m.centres)
        sums, count, inertia = m._step(dealt, range(2 * b, 2 * b + 2))
        assert count.tolist() == np.bincount(near, minlength=2).tolist() and np.allclose(sums, [own[near == k].sum(0) for k in (0, 1)]) and np.isclose(inertia, d.sum())
        seen += count.sum()
    assert seen == 5000


def test_runs_are_streamed_through_tasks_not_called_one_by_one(spark):
    """Many short runs, a null one, and one longer than a batch, by sorted partitions: no call a run."""
    from tidewake.operators import training

    rows = [(r, k, float((7 * k + r) % 13)) for r in range(40) for k in range(3)] + [(None, k, float(k % 3)) for k in range(5)] + [(99, k, float(k * 7919 % 1000)) for k in range(25000)]
    d = spark.createDataFrame(rows, "run long, k long, loss double").repartition(3)
    out = training.smoothed(d, "run", "k", "loss", 0.25, 4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
    want = {}
    for r in sorted({x[0] for x in rows}, key=str):
        now, least, idle, stopped = None, float("inf"), 0, False
        for _, k, x in sorted((x for x in rows if x[0] == r), key=lambda x: x[1]):
            now = x if now is None else now * 0.75 + x * 0.25
            idle = 0 if now < least else idle + 1
            least, stopped = min(least, now), stopped or idle >= 4
            want[r, k] = (x, now, idle, stopped)
    assert {(r.run, r.step): (r.value, r.smoothed, r.idle, r.stopped) for r in out.collect()} == want
