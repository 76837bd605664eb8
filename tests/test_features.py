import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewake.operators import features, signal


def literal(x):
    n, mu = len(x), x.mean()
    s = x.std(ddof=1)
    z = (x - mu) / (s + 1e-12)
    i = np.arange(n)
    return {"mean": mu, "std": s, "skew": (z**3).mean(), "kurt": (z**4).mean() - 3, "max": x.max(), "min": x.min(), "autocorr": ((x[1:] - mu) * (x[:-1] - mu)).mean() / (s * s + 1e-12), "trend": ((i - i.mean()) * (x - mu)).sum()}


def clip(spark, values, name="a"):
    return spark.createDataFrame([(name, k, float(v)) for k, v in enumerate(values)], "clip_id string, t long, x double")


def test_three_rows(spark):
    r = features.channel_features(clip(spark, [1, 2, 3]), ["x"], 5).collect()[1]
    assert (r.x_mean, r.x_std, r.x_trend) == (2.0, 1.0, 2.0)
    assert r.x_skew == pytest.approx(0) and r.x_kurt == pytest.approx(2 / 3 - 3) and r.x_autocorr == pytest.approx(0)


def test_against_numpy_with_cut_frames(spark):
    x = np.random.default_rng(3).normal(size=40)
    got = {r.t: r for r in features.channel_features(clip(spark, x), ["x"], 4).collect()}
    for t in range(40):
        for k, v in literal(x[max(0, t - 4) : t + 5]).items():
            assert got[t][f"x_{k}"] == pytest.approx(v, abs=1e-8)


@pytest.mark.parametrize(("n", "half", "part"), [(40, 4, 10), (41, 20, 16), (30, 40, 7), (64, 3, 7), (9, 1, 2), (50, 0, 8)])
def test_parts_of_a_clip_give_the_same(spark, monkeypatch, n, half, part):
    rng = np.random.default_rng(n)
    x, y = 1e6 + rng.normal(size=n), rng.normal(size=n)  # far from zero: sums would lose digits
    f = spark.createDataFrame([("a", k, float(x[k]), float(y[k])) for k in range(n)] + [("b", 0, 1.0, 2.0)], "clip_id string, t long, x double, y double")
    frame = features.Frame(half, part)
    made = {**{k: v for k, v in frame.stats("x").items()}, "corr": frame.corr("x", "y"), "circle": frame.circular_variance(F.col("y"), "y"), "dynamic": frame.dynamic(["x", "y"])}
    got = {r.t: r for r in frame.over(f).select("clip_id", "t", *(v.alias(k) for k, v in made.items())).where("clip_id = 'a'").collect()}
    assert sorted(got) == list(range(n))
    for t in range(n):
        a, b = x[max(0, t - half) : t + half + 1], y[max(0, t - half) : t + half + 1]
        assert got[t]["circle"] == pytest.approx(1 - abs(np.exp(1j * b).mean()), abs=1e-9) and got[t]["dynamic"] == pytest.approx((abs(a) + abs(b)).mean())
        if len(a) > 1:
            assert got[t]["corr"] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-6)
            for k, v in literal(a).items():
                assert got[t][k] == pytest.approx(v, abs=1e-4 if k == "trend" else 1e-6)


def test_no_window_of_the_frame_itself(spark):
    """The cost of a row doesn't depend on the frame: only running aggregates and single rows ahead and behind."""
    plan = features.channel_features(clip(spark, [1.0]), ["x"], 800)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "-800" in plan
    assert not [f for f in re.findall(r"specifiedwindowframe\(RowFrame, ([^)]*)\)", plan) if "unbounded" not in f and len({x.strip() for x in f.split(",")}) > 1]


def test_constant_frames(spark):
    r = features.channel_features(clip(spark, [2.0] * 6), ["x"], 2).first()
    assert (r.x_skew, r.x_kurt, r.x_std, r.x_trend) == (0.0, -3.0, 0.0, 0.0)


@pytest.mark.parametrize(("channels", "size"), [(["AccX", "AccY", "AccZ"], 38), (["AccX", "AccY", "AccZ", "Depth"], 46), (["AccX", "AccY", "AccZ", "GyrX", "GyrY", "GyrZ", "Depth"], 73)])
def test_feature_vector_sizes(spark, channels, size):
    rng = np.random.default_rng(1)
    rows = [("a", k, *map(float, rng.normal(size=len(channels)))) for k in range(12)]
    f = spark.createDataFrame(rows, "clip_id string, t long, " + ", ".join(f"{c} double" for c in channels))
    out = features.feature_set(f, channels, 3, dynamic_only=True)
    assert len(out.columns) - 2 == size and out.na.drop().count() == 12
    with pytest.raises(ValueError):
        features.feature_set(f, channels, 3)


def test_window_rows():
    assert (features.window_rows(1, 50), features.window_rows(0.5, 1), features.window_rows(2.5, 3)) == (50, 3, 8)


def by_definition(x, n, cut):
    h, half, size = signal.taps(n, cut), n // 2, len(x)
    out = []
    for i in range(size):
        y = 0.0
        for k in range(n + 1):
            j = i + half - k
            y += h[k] * (0.0 if j == -half else x[-j] if j < 0 else x[2 * (size - 1) - j] if j > size - 1 else x[j])
        out.append(y)
    return np.array(out)


@pytest.mark.parametrize("n", [10, 11, 80])
def test_high_pass(n):
    x = np.random.default_rng(2).normal(size=90)
    assert np.abs(signal.high_pass(x, n, 0.3) - by_definition(x, n // 2 * 2, 0.3)).max() < 1e-12


@pytest.mark.parametrize(("n", "rows", "part"), [(10, 90, 20), (11, 61, 7), (80, 90, 30), (80, 81, 80), (30, 100, 3)])
def test_filters_and_wavelets_over_parts_equal_the_whole_clip(spark, n, rows, part):
    x = np.random.default_rng(rows).normal(size=rows)
    f = clip(spark, x).withColumnRenamed("x", "AccX").unionByName(clip(spark, x[: n + 5], "b").withColumnRenamed("x", "AccX"))
    for name, size in (("a", rows), ("b", min(rows, n + 5))):
        got = {r.t: r for r in signal.filtered(f, ["AccX"], n, 0.3, part).where(f"clip_id = '{name}'").collect()}
        want = signal.high_pass(x[:size], n, 0.3)
        assert sorted(got) == list(range(size)) and max(abs(got[t].AccX_dynamic - want[t]) for t in range(size)) < 1e-10
        w = {r.t: r["values"] for r in signal.wavelets(f, ["AccX"], 1.0, n=3, longest=12, every=2, normalise=True, part=part).where(f"clip_id = '{name}'").collect()}
        m = signal.morlet((x[:size] - x[:size].mean()) / (x[:size].std() + 1e-6), 1.0, 3, None, 12, 10)
        assert sorted(w) == list(range(0, size, 2)) and np.abs(np.array([w[t] for t in sorted(w)]).T - m[:, ::2]).max() < 1e-4


def test_taps_gain_one_at_nyquist():
    h = signal.taps(20, 0.4)
    assert (h * np.cos(math.pi * (np.arange(21) - 10))).sum() == pytest.approx(1)


def test_static_and_dynamic_sum_to_the_signal(spark):
    f = clip(spark, np.full(40, 3.0)).withColumnRenamed("x", "AccX")
    out = signal.static_dynamic(f, ["AccX"], 1.0, 4.0)
    assert out.columns == ["clip_id", "t", "AccX_static", "AccX_dynamic"]
    assert all(r.AccX_static + r.AccX_dynamic == pytest.approx(3.0) for r in out.collect())
    assert signal.static_dynamic(f, ["AccX"], 0, 4.0) is f


def test_wavelet_peaks_at_its_period(spark):
    x = np.sin(2 * np.pi * np.arange(400) / 16)
    m = signal.morlet(x, 1.0, 7, 4, 256, 10)
    assert m[:, 200].argmax() == 2  # 4, 8, 16, ...
    out = signal.wavelets(clip(spark, x[:50]), ["x"], 1.0, n=3, longest=10, every=5)
    assert out.count() == 10 and len(out.first()["values"]) == 3


def test_whitening(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) @ np.array([[3, 0, 0], [1, 1, 0], [0, 0, 0.1]])
    df = spark.createDataFrame([(Vectors.dense(v),) for v in x.tolist()], ["features"])
    w = np.array([r.white.toArray() for r in signal.Whitening(3).fit(df).transform(df).collect()])
    assert np.abs(np.cov(w.T) - np.eye(3)).max() < 0.02


def test_tasks_of_frames_follow_the_rows(spark, monkeypatch):
    """However few shuffle partitions the session has and whatever adaptive plans would merge."""
    monkeypatch.setattr(features, "TASK", 100)
    d = spark.range(2000).selectExpr("id % 50 AS clip_id", "id div 50 AS t", "cast(id % 11 AS double) AS x")
    plan = features.channel_features(d, ["x"], 2, ("mean", "std"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(clip_id" in plan and "_part" in plan and ", 20), REPARTITION_BY_NUM" in plan
