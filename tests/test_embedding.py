import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidewake.operators import embedding as em
from tidewake.operators import models
from tidewake.operators import neighbours as nb


def spectra(rng, groups=3, each=60, dims=6):
    """Clearly apart: each group's mass is on dimensions of its own."""
    x = np.concatenate([rng.dirichlet(np.where(np.arange(dims) // 2 == g, 20.0, 1.0), each) for g in range(groups)])
    return x, np.repeat(np.arange(groups), each)


@pytest.fixture(scope="module")
def world(spark):
    x, group = spectra(np.random.default_rng(3))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").select("id", nb.shares(F.col("v")).alias("v"))
    graph = nb.cut(nb.neighbours(rows, 10))
    return rows, graph, nb.cut(nb.fuzzy(graph, 10)), group


def places(df):
    return {r.id: (r.x, r.y) for r in df.collect()}


def test_curve_fits_closeness():
    a, b = em.curve(0.1)
    assert (a, b) == (pytest.approx(1.577, abs=0.01), pytest.approx(0.895, abs=0.005))
    d = np.linspace(0.01, 3, 300)
    want = np.where(d < 0.5, 1, np.exp(-(d - 0.5)))
    a, b = em.curve(0.5)
    assert np.abs(1 / (1 + a * d ** (2 * b)) - want).max() < 0.12


def test_field_is_the_mean_of_all_repulsions(spark):
    rng = np.random.default_rng(5)
    p = rng.normal(size=(400, 2)) * 4
    a, b = em.curve(0.1)
    grid = em.field(spark.createDataFrame(p.tolist(), "x double, y double").withColumn("id", F.monotonically_increasing_id()), a, b)
    far = np.array([[9.0, 1.0], [-8.0, -7.0], [0.5, 8.0], [3.0, -6.0]])
    far = far.clip(p.min(0), p.max(0))
    got = em.read(*grid, far[:, 0], far[:, 1])
    d = far[:, None] - p[None]
    s = (d**2).sum(2)
    want = np.clip((2 * b / ((em.NEAR + s) * (1 + a * s**b)))[:, :, None] * d, -em.LIMIT, em.LIMIT).mean(1)
    assert np.abs(got - want).max() < 0.05 * np.abs(want).max() + 2e-3


def test_pulls_equal_sums_over_edges(spark):
    rng = np.random.default_rng(6)
    p, e = rng.normal(size=(20, 2)), [(i, j, float(rng.uniform())) for i in range(20) for j in range(i) if rng.uniform() < 0.3]
    a, b = em.curve(0.1)
    both = e + [(j, i, w) for i, j, w in e]
    got = {r.a: r for r in em.pulls(spark.createDataFrame(both, "a long, b long, weight double"), spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(p)], "id long, x double, y double"), a, b).collect()}
    for i, r in got.items():
        mine = [(j, w) for k, j, w in both if k == i]
        s = np.array([max(((p[j] - p[i]) ** 2).sum(), em.NEAR) for j, _ in mine])
        g = np.array([w for _, w in mine]) * 4 * a * b * s ** (b - 1) / (1 + a * s**b)
        assert r.springs == pytest.approx(g.sum(), abs=1e-4) and r.degree == pytest.approx(sum(w for _, w in mine), abs=1e-4)
        assert (r.px, r.py) == pytest.approx(tuple((g[:, None] * np.array([p[j] - p[i] for j, _ in mine])).sum(0)), abs=1e-4)


def test_map_keeps_groups_and_neighbours_and_ignores_partitions(world):
    rows, graph, weights, group = world
    begin = em.start(rows)
    got = places(em.layout(weights, begin, rounds=15))
    p = np.array([got[k] for k in range(len(group))])
    d = ((p[:, None] - p[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, 1)[:, :10]
    assert (group[near] == group[:, None]).mean() > 0.97
    edges = [(r.a, r.b) for r in graph.collect()]
    kept = np.mean([b in np.argsort(d[a])[:20] for a, b in edges])
    q = np.array([v for _, v in sorted(places(begin).items())])
    s = ((q[:, None] - q[None]) ** 2).sum(2)
    np.fill_diagonal(s, np.inf)
    assert kept > np.mean([b in np.argsort(s[a])[:20] for a, b in edges]) and kept > 0.6
    assert places(em.layout(weights.repartition(7), begin.repartition(3), rounds=2)) == places(em.layout(weights, begin, rounds=2))


def test_search_finds_nine_of_ten(world, spark):
    rows, graph, _, _ = world
    x, _ = spectra(np.random.default_rng(9), each=15)
    new = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").select("id", nb.shares(F.col("v")).alias("v"))
    got = em.search(new, rows, graph, 10).collect()
    a, b = (np.array([r.v for r in t.orderBy("id").collect()]) for t in (new, rows))
    d = ((a[:, None] - b[None]) * (np.log(a)[:, None] - np.log(b)[None])).sum(2) / 2
    assert len(got) == 450 and all(r.d == pytest.approx(d[r.a, r.b]) for r in got)
    want = np.argsort(d, 1)[:, :10]
    assert sum(r.b in want[r.a] for r in got) >= 0.9 * 450
    same = em.search(rows.where("id < 20"), rows, graph, 10).where("a = b")
    assert same.count() == 20  # a fitted row finds itself
    alone = em.search(new.where("id < 0"), rows, graph, 10)
    assert alone.count() == 0


def test_fitted_rows_stand_on_their_places(world):
    rows, graph, _, _ = world
    at = em.start(rows)
    assert places(em.placed(em.search(rows, rows, graph, 10), at, 10)) == places(at)


@pytest.fixture(scope="module")
def clips(spark):
    x, group = spectra(np.random.default_rng(4), each=40)
    order = np.random.default_rng(2).permutation(len(group) // 4)  # each spectrum for four rows, so that thinning loses none
    rows = [(f"c{k % 2}", 4 * (k // 2) + j, int(group[i * 4]), Vectors.dense(x[i * 4])) for k, i in enumerate(order) for j in range(4)]
    return spark.createDataFrame(rows, ["clip_id", "t", "label", "features"])


def test_model_finds_groups_and_is_saved(spark, clips, tmp_path):
    settings = {"n_neighbors": 5, "downsample": 2, "image_size": 128, "image_border": 8, "rounds": 6, "n_watershed_trials": 3}
    m = models.model("umapper", 6, 0, **settings).fit(clips.where("t % 2 = 0"))
    got = m.predict(clips)
    rows = got.collect()
    assert got.columns == [*clips.columns, "pred"] and len(rows) == clips.count() and {r.pred for r in rows} <= set(range(6))
    of = {}
    for r in rows:
        of.setdefault(r.pred, []).append(r.label)
    assert sum(max(v.count(x) for x in v) for v in of.values()) > 0.95 * len(rows)
    m.save(str(tmp_path / "m"), spark)
    again = models.load(str(tmp_path / "m"), spark).predict(clips).collect()
    assert sorted((r.clip_id, r.t, r.pred) for r in again) == sorted((r.clip_id, r.t, r.pred) for r in rows)
    assert m.diagnostics(spark)["map"].count() == clips.where("t % 2 = 0").count()


def test_equal_rows_one_row_and_none(spark, clips):
    settings = {"n_neighbors": 5, "downsample": 1, "image_size": 64, "image_border": 4, "rounds": 1, "n_watershed_trials": 1}
    same = spark.createDataFrame([("a", t, Vectors.dense([1.0, 2.0, 0.0])) for t in range(30)], ["clip_id", "t", "features"])
    assert {r.pred for r in models.model("umapper", 4, 0, **settings).fit(same).predict(same).collect()} <= set(range(4))
    one = same.where("t = 0")
    assert [r.pred for r in models.model("umapper", 4, 0, **settings).fit(one).predict(one).collect()] == [0]
    with pytest.raises(ValueError, match="no rows"):
        models.model("umapper", 4, 0, **settings).fit(same.where("t < 0"))
