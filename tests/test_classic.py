import math
import random

from tidewake.operators import frames as fr
from tidewake.operators.classic import Classic
from tidewake.plans import config


def recording(spark):
    rng, rows = random.Random(2), []
    for clip in range(4):
        for t in range(200):
            y = 1 + (t // 50) % 2
            rows.append((f"c{clip}", t, clip % 2, y if t % 5 else 0, *(rng.gauss(0, 0.2 if y == 1 else 3.0) for _ in range(3))))
    return spark.createDataFrame(rows, "clip_id string, t long, individual_id int, label int, AccX double, AccY double, AccZ double")


def test_classic_predicts_every_row(spark, tmp_path):
    d = recording(spark)
    for extra in ({}, {"normalize": True, "downsizing_factor": 2}):
        settings = config.with_defaults({"model": "dt", "model_config": {"context_window_sec": 1, **extra}})["model_config"]
        m = Classic("dt", ["AccX", "AccY", "AccZ"], [1, 2], 10, settings, balance=True, dynamic_only=True).fit(d)
        assert m.half == 5
        out = m.predict(d)
        m.save(f"{tmp_path}/m{len(extra)}", spark)
        again = Classic.load(f"{tmp_path}/m{len(extra)}", spark).predict(d)
        assert {(r.clip_id, r.t, r.pred) for r in again.collect()} == {(r.clip_id, r.t, r.pred) for r in out.collect()}
        assert out.count() == 800 and out.join(d.where("label > 0"), ["clip_id", "t"]).where("pred = label").count() > 0.95 * 640


def test_upsampled_and_segments(spark):
    d = spark.createDataFrame([("a", t, t) for t in range(10)] + [("b", 0, 7)], "clip_id string, t long, pred int")
    got = {(r.clip_id, r.t): r.pred for r in fr.upsampled(d, fr.every_nth(d, 4), 4).collect()}
    assert got == {("a", t): 4 * math.floor((t + 0.5) * 3 / 10) for t in range(10)} | {("b", 0): 7}
    s = fr.segments(d, 3, 6).collect()
    assert len(s) == 3 and s == fr.segments(d.repartition(3), 3, 6).collect()
    assert all((r.start, r.end) == (0, 1) if r.clip_id == "b" else r.end - r.start == 6 and 0 <= r.start < 4 for r in s)
    assert fr.segments(d.where("t < 0")).count() == 0


def test_raster(spark):
    p = spark.createDataFrame([(0.0, 0.0), (1.0, 2.0), (1.0, 2.0)], "x double, y double")
    assert {(r.row, r.col): (r.n, r.density) for r in fr.raster(p, 10, 1).collect()} == {(1, 1): (1, 0.5), (5, 9): (2, 1.0)}
    assert fr.raster(p.where("x < 0"), 10, 1).count() == 0 and fr.raster(p.where("x > 0"), 10, 1).count() == 1


def test_normalize_scales_acceleration_whether_split_or_not(spark):
    from tidewake.operators import signal

    d = recording(spark)
    acc = ["AccX", "AccY", "AccZ"]
    split = signal.static_dynamic(d, acc, 1.0, 10.0)
    parts = {c: [f"{c}_static", f"{c}_dynamic"] for c in acc}
    before = signal.static_dynamic(signal.scale_acceleration(d, acc), acc, 1.0, 10.0)
    after = signal.scale_acceleration(split, acc, parts)
    a, b = ({(r.clip_id, r.t): r for r in x.collect()} for x in (before, after))
    assert max(abs(a[k][c] - b[k][c]) for k in a for x in parts.values() for c in x) < 1e-9
