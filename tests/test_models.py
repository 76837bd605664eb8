import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tidewake.operators import models


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    data = []
    for k in range(240):
        y = 1 + (k // 20) % 2
        data.append((f"c{k // 120}", k % 120, y, Vectors.dense(rng.normal(loc=4.0 * y, size=2))))
    return spark.createDataFrame(data, ["clip_id", "t", "label", "features"]).selectExpr("clip_id", "t", "cast(label as int) as label", "features")


def agreement(df):
    got = [(r.label, r.pred) for r in df.collect()]
    pairs = {}
    for y, p in got:
        pairs.setdefault(p, []).append(y)
    return sum(max(v.count(y) for y in set(v)) for v in pairs.values()) / len(got)


@pytest.mark.parametrize(("name", "how"), [("kmeans", {"n_init": 2, "max_iter": 10}), ("gmm", {"max_iter": 100}), ("hmm", {"temporal_window_samples": 60, "N_iters": 5}), ("hmm", {"temporal_window_samples": 60, "N_iters": 5, "covariance": "full"}), ("rf", {"n_estimators": 5, "max_samples": 0.5, "max_depth": 4}), ("dt", {"max_depth": 4}), ("svm", {"max_iter": 5}), ("kmeans", {"n_init": 1, "max_iter": 10, "whiten": True, "n_components": 1})])
def test_models_find_two_classes(rows, tmp_path, name, how):
    m = models.model(name, 2, 0, **how).fit(rows)
    out = m.predict(rows)
    assert out.count() == rows.count() and agreement(out) > 0.95
    if name in ("rf", "dt", "svm"):
        assert out.where("label = pred").count() > 0.95 * rows.count()
    m.save(str(tmp_path / "m"))
    again = models.load(str(tmp_path / "m")).predict(rows)
    assert {(r.clip_id, r.t): r.pred for r in again.collect()} == {(r.clip_id, r.t): r.pred for r in out.collect()}


def test_random_is_stable(rows):
    m = models.model("random", 5)
    a = {(r.clip_id, r.t): r.pred for r in m.predict(rows).collect()}
    assert a == {(r.clip_id, r.t): r.pred for r in m.predict(rows.repartition(3)).collect()} and set(a.values()) == set(range(5))


def test_names():
    with pytest.raises(ValueError):
        models.model("nothing", 2)
    with pytest.raises(NotImplementedError):
        models.model("CRNN", 2)


def test_viterbi_follows_sticky_states():
    x = np.array([[0.0]] * 5 + [[9.0]] * 5)
    s = models.viterbi(x, np.log([0.5, 0.5]), np.log([[0.9, 0.1], [0.1, 0.9]]), np.array([[0.0], [9.0]]), np.ones((2, 1)))
    assert s.tolist() == [0] * 5 + [1] * 5


def test_paths_in_parts_equal_the_whole_clip(spark, monkeypatch):
    rng = np.random.default_rng(4)
    k, d = 3, 2
    m = models.Hmm(k, 0)
    m.start, m.move = np.log(rng.dirichlet(np.ones(k))), np.log(rng.dirichlet(np.ones(k) + 5 * np.eye(k)[0], size=k))
    m.mean, m.var, m.centre, m.scale = rng.normal(size=(k, d)), rng.uniform(0.5, 2, size=(k, d)), np.array([1.0, -2.0]), np.array([2.0, 0.5])
    clips = {"a": rng.normal(size=(61, d)), "b": rng.normal(size=(7, d)), "c": rng.normal(size=(1, d)), "d": rng.normal(size=(14, d))}
    rows = spark.createDataFrame([(c, 3 * t, Vectors.dense(v)) for c, x in clips.items() for t, v in enumerate(x)], ["clip_id", "t", "features"])
    for size in (1, 7, 100):
        monkeypatch.setattr(models.Hmm, "PART", size)
        got = {(r.clip_id, r.t): r.pred for r in m.predict(rows).collect()}
        want = {(c, 3 * t): p for c, x in clips.items() for t, p in enumerate(models.viterbi((x - m.centre) / m.scale, m.start, m.move, m.mean, m.var))}
        assert got == want
    whole = models.transfer(clips["a"], m.move, m.mean, m.var)
    left, right = models.transfer(clips["a"][:20], m.move, m.mean, m.var), models.transfer(clips["a"][20:], m.move, m.mean, m.var)
    assert np.abs((left[:, :, None] + right[None]).max(1) - whole).max() < 1e-9


def test_hmm_scales_by_the_rows_of_whole_chunks(rows, spark):
    far = rows.selectExpr("clip_id", "t * 4 AS t", "label", "features").unionByName(spark.createDataFrame([("short", 0, 1, Vectors.dense([1e6, 1e6]))], rows.schema))
    m = models.model("hmm", 2, 0, temporal_window_samples=60, N_iters=8).fit(far)
    x = np.array([r.features.toArray() for r in rows.collect()])
    assert np.allclose(m.centre, x.mean(0)) and np.allclose(m.scale, x.std(0)) and len(m.likelihood) == 8
    assert agreement(m.predict(far).where("clip_id <> 'short'")) > 0.95
    tables = m.diagnostics(spark)
    assert tables["likelihood"].count() == 8 and abs(tables["transitions"].groupBy("state").sum("probability").first()[1] - 1) < 1e-9
    with pytest.raises(ValueError, match="whole chunk"):
        models.model("hmm", 2, 0, temporal_window_samples=500).fit(far)


def test_hmm_sums_of_chunks_are_those_of_each_alone(monkeypatch):
    """Chunks taken side by side, in any number at once, give the sums of the recursions over one chunk after another."""
    import pyarrow as pa

    rng, k, d, w = np.random.default_rng(5), 3, 2, 7
    m = models.Hmm(k, 0)
    m.start, m.move = (np.log(rng.dirichlet(np.ones(k), n)) for n in (1, k))
    m.start, m.mean, m.var = m.start[0], rng.normal(size=(k, d)), rng.uniform(0.5, 2, size=(k, d))
    x = rng.normal(size=(11, w, d))
    want = np.zeros(1 + k + k * k + k + 2 * k * d)
    for c in x:
        states = np.array(np.meshgrid(*[range(k)] * w, indexing="ij")).reshape(w, -1).T  # all paths
        emit = models._log_normal(c, m.mean, m.var)
        p = np.exp(m.start[states[:, 0]] + emit[np.arange(w), states].sum(1) + m.move[states[:, :-1], states[:, 1:]].sum(1))
        q, one = p / p.sum(), np.eye(k)[states]
        gamma, pair = np.einsum("p,pwk->wk", q, one), np.einsum("p,pwi,pwj->ij", q, one[:, :-1], one[:, 1:])
        want += np.concatenate(([np.log(p.sum())], gamma[0], pair.ravel(), gamma.sum(0), (gamma.T @ c).ravel(), (gamma.T @ (c * c)).ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(x.reshape(11, -1).tolist(), pa.list_(pa.float64()))], ["x"])
    for side in (1, 3 * w, 1 << 13):
        monkeypatch.setattr(models.Hmm, "SIDE", side)
        (got,) = m._expect(w, d)(iter([batch.slice(0, 4), batch.slice(4)]))
        assert np.allclose(got.column("part")[0].as_py(), want)


def test_fits_pass_over_as_many_partitions_as_their_rows_need(spark, monkeypatch):
    """Clips and shuffle partitions don't decide how many tasks a pass has; trees aren't shipped in each pass."""
    from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, RandomForestClassifier
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from tidewake.functions import lineage

    d = spark.range(400).select((F.col("id") % 40).alias("clip_id"), F.col("id").alias("t"), (1 + F.col("id") % 2).cast("int").alias("label"), array_to_vector(F.array(F.col("id").cast("double"), (F.col("id") % 2).cast("double"))).alias("features")).repartition(64, "clip_id")
    seen = []
    for kind in (KMeans, LinearSVC, RandomForestClassifier, DecisionTreeClassifier):
        monkeypatch.setattr(kind, "fit", lambda self, rows, params=None, own=kind.fit: seen.append((type(self).__name__, rows.rdd.getNumPartitions())) or own(self, rows, params))
    for name, settings in (("kmeans", {"n_init": 1, "max_iter": 3}), ("rf", {"n_estimators": 2, "max_samples": 1.0}), ("dt", {}), ("svm", {"max_iter": 5})):
        m = models.model(name, 2, 0, **settings).fit(d)
        assert m.predict(d).count() == 400
        if name in ("rf", "dt"):
            assert m._estimator().getCacheNodeIds() and m.predict(d).where("label = pred").count() > 390
    assert {n for _, n in seen} == {1} and {k for k, _ in seen} >= {"KMeans", "RandomForestClassifier", "DecisionTreeClassifier"}
    monkeypatch.setattr(lineage, "ROWS", 50)
    x = lineage.dealt(d.select("clip_id", "t"), "clip_id", "t")
    assert x.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and sorted(map(tuple, x.collect())) == sorted(map(tuple, d.select("clip_id", "t").collect()))


def test_a_forest_of_many_nodes_is_fitted_in_groups(rows, tmp_path, monkeypatch):
    """No fit may have more nodes than the driver is to hold; the groups are one forest, with votes of all trees."""
    from pyspark.ml.classification import RandomForestClassifier

    monkeypatch.setattr(models, "NODES", 2 * rows.count(), raising=False)
    seen, own = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, d, params=None: seen.append((self.getNumTrees(), self.getSeed())) or own(self, d, params))
    m = models.model("rf", 2, 0, n_estimators=5, max_samples=0.5).fit(rows)
    assert sum(n for n, _ in seen) == 5 and seen[0][0] == 2 and len({s for _, s in seen}) == len(seen) > 1
    out = m.predict(rows)
    assert out.columns == [*rows.columns, "pred"] and out.count() == rows.count() and out.where("label = pred").count() > 0.95 * rows.count()
    m.save(str(tmp_path / "m"))
    assert sorted((r.clip_id, r.t, r.pred) for r in models.load(str(tmp_path / "m")).predict(rows).collect()) == sorted((r.clip_id, r.t, r.pred) for r in out.collect())
