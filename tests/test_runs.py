import random

import pytest
from pyspark.sql import functions as F

from tidewake.operators import frames as fr
from tidewake.operators import runs, training
from tidewake.plans.config import Metadata


def dataset(spark):
    rng, rows, clips = random.Random(3), [], [f"c{k}" for k in range(3)]
    for k, clip in enumerate(clips):
        for t in range(80):
            y = 1 + (t // 20) % 2
            rows.append((clip, t, *(rng.gauss(0, 0.2 if y == 1 else 3.0) for _ in range(3)), k, y if t % 5 else 0))
    columns = ["AccX", "AccY", "AccZ", "individual_id", "label"]
    meta = Metadata("toy", 5.0, columns, ["unknown", "rest", "move"], clips, {c: k for k, c in enumerate(clips)}, {k: [c] for k, c in enumerate(clips)}, n_folds=3, mean_overall_dur_sec=4.0, mean_dur_sec_by_individual={k: 4.0 for k in range(3)}, dynamic_acc_only=True)
    return spark.createDataFrame(rows, "clip_id string, t long, AccX double, AccY double, AccZ double, individual_id int, label int"), meta


def point(name, model="dt", **own):
    return {"model": model, "experiment_name": name, "test_folds": [0], "model_config": own}


def test_sweep_resumes_and_best_goes_to_the_other_folds(spark, tmp_path, monkeypatch):
    d, meta = dataset(spark)
    points = [point("p0", context_window_sec=1), point("p1", model="iic")]
    out = runs.cross_validate(d, meta, points, str(tmp_path))  # the second point can't run here, and is left out
    scores = {r.split: r for r in out["scores"].collect()}
    assert scores["test"].f1_mean > 0.8 and out["confusion"].where("split = 'test'").agg(F.sum("n")).first()[0] == 2 * 64
    assert {(r.split, r.label): r.truth for r in out["labels"].collect()}[("test", 1)] == 2 * 32 and out["confusion"].where("split = 'train'").count() == 4
    from tidewake.sources import clips

    told = clips.read_yaml(spark, f"{tmp_path}/hyperparameter_selection/summary")
    assert told["done"] == ["p0"] and "umap" in told["failed"]["p1"]
    again = []
    monkeypatch.setattr(runs, "predictions", lambda *a: again.append(a))
    assert runs.sweep(d, meta, points[:1], f"{tmp_path}/hyperparameter_selection", resume=True)["experiment_name"] == "p0" and not again


def test_models_without_labels_and_settings_files(spark, tmp_path):
    d, meta = dataset(spark)
    from tidewake.sources import clips

    clips.write_document(spark, point("k", "kmeans", max_iter=5, n_init=1, whiten=False) | {"output_parent_dir": str(tmp_path)}, f"{tmp_path}/k.json")
    folder = runs.run_config(spark, f"{tmp_path}/k.json", d, meta)
    assert spark.read.parquet(f"{folder}/predictions").count() == 240 and spark.read.parquet(f"{folder}/mapping").count() == 20
    with pytest.raises(ValueError, match="vame"):
        runs.sweep(d, meta, [point("x", "vame")], str(tmp_path))
    want = {(r.clip_id, r.t): r.pred for r in spark.read.parquet(f"{folder}/predictions").collect()}
    assert {(r.clip_id, r.t): r.pred for r in runs.predict_saved(spark, folder, d.drop("label", "individual_id"), meta).collect()} == want


def test_a_classic_run_keeps_its_model(spark, tmp_path):
    d, meta = dataset(spark)
    folder = runs.run(d, meta, point("p", normalize=True, context_window_sec=1) | {"val_folds": [1]}, str(tmp_path))
    want = {(r.clip_id, r.t): r.pred for r in spark.read.parquet(f"{folder}/predictions").collect()}
    assert {(r.clip_id, r.t): r.pred for r in runs.predict_saved(spark, folder, d.drop("label", "individual_id"), meta).collect()} == want
    assert {r.split for r in spark.read.parquet(f"{folder}/individual").collect()} == {"test", "val", "train"}


def test_a_hidden_markov_run_strides_wavelets_only(spark, tmp_path):
    d, meta = dataset(spark)
    folder = runs.run(d, meta, point("h", "hmm", downsample=2, temporal_window_samples=40, N_iters=3) | {"num_clusters": 2}, str(tmp_path))
    assert spark.read.parquet(f"{folder}/likelihood").count() == 3 and spark.read.parquet(f"{folder}/transitions").count() == 4
    told = d.withColumn("split", F.lit("train"))
    rows = lambda model, **own: runs.training_rows(told, {"model": model, "model_config": own})
    assert [rows("hmm", downsample=2).count(), rows("hmm", downsample=2, wavelet_transform=True).count(), rows("kmeans", downsample=50).count(), rows("gmm", downsample=50).count()] == [240, 120, 6, 5]
    assert sorted((r.clip_id, r.t) for r in rows("gmm", downsample=50).collect()) == [("c0", 0), ("c0", 50), ("c1", 20), ("c1", 70), ("c2", 40)]


def test_runs_overlap_and_one_failing_leaves_others(spark, tmp_path, monkeypatch):
    import threading

    d, meta = dataset(spark)
    met = threading.Barrier(2, timeout=60)

    def slow(frames, meta, settings, path, resume):
        name = settings["experiment_name"]
        if name in ("a", "b"):
            met.wait()  # both must be there
        if name == "bad":
            raise RuntimeError("no such luck")
        if name == "long":
            spark.range(2).repartition(2).mapInPandas(lambda it: [__import__("time").sleep(60) or x for x in it], "id long").collect()
        return f"{path}/{name}"

    monkeypatch.setattr(runs, "run", slow)
    failed = {}
    done = runs.run_all(d, meta, [point(n) for n in ("a", "b", "bad", "c")], "x", at_once=2, failed=failed)
    assert done == {n: f"x/{n}" for n in "abc"} and failed == {"bad": "no such luck"}
    failed = {}
    assert runs.run_all(d, meta, [point("long"), point("c")], "x", failed=failed, seconds=3) == {"c": "x/c"} and "seconds" in failed["long"]


def test_wavelets_and_static_parts(spark):
    from tidewake.plans import config

    d, meta = dataset(spark)
    told = d.withColumn("split", F.when(F.col("clip_id") == "c0", "test").otherwise("train"))
    wave = config.with_defaults(point("w", "wavelet_dt", wavelet_transform=True, feature_set="wavelet", n_wavelets=3, C_max=4.0, per_channel_normalize=True))
    pred, clusters = runs.predictions(told, meta, wave)
    assert pred.count() == 240 and clusters is None
    still = Metadata.of(vars(meta) | {"dynamic_acc_only": False})
    assert runs.predictions(told, still, config.with_defaults(point("s") | {"static_acc_cutoff_freq": 0.5}))[0].count() == 240


def test_noise_has_its_deviation_and_is_kept(spark):
    d = spark.range(20_000).select(F.lit("a").alias("clip_id"), F.col("id").alias("t"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    n = training.noisy(d, ["x", "y"], blur=2.0)
    m = n.agg(F.avg("x"), F.stddev("x"), F.corr("x", "y")).first()
    assert abs(m[0]) < 0.06 and abs(m[1] - 2) < 0.06 and abs(m[2]) < 0.05
    assert training.noisy(d, ["x", "y"], jitter=1.0).where("x <> y").count() == 0 and training.noisy(d, ["x"]).where("x <> 0").count() == 0
    assert n.orderBy("t").take(5) == training.noisy(d.repartition(5), ["x", "y"], blur=2.0).orderBy("t").take(5)
    w = training.noisy_windows(d.withColumn("x", F.when(F.col("t") % 2 == 0, 1.0).otherwise(-1.0)), 1000, ["x"]).agg(F.var_samp("x")).first()[0]
    assert abs(w - (1 + 0.64)) < 0.06


def test_random_rescaling_takes_rows_of_its_span(spark):
    d = spark.range(50).select(F.lit("a").alias("clip_id"), F.col("id").alias("t"), F.col("id").alias("v"))
    got = fr.rescaled_windows(d, 10, "v", 0.5).collect()
    assert len(got) == 40 and all(len(r["values"]) == 10 and r["values"][0] == r.t and r["values"] == sorted(r["values"]) and r["values"][-1] < min(50, r.t + 15) for r in got)
    assert all(r["values"] == list(range(r.t, r.t + 10)) for r in fr.rescaled_windows(d, 10, "v", 0).collect())


def test_peaks_ties_and_empty(spark):
    cells = spark.createDataFrame([(0, 0, 3), (0, 1, 3), (1, 1, 2), (5, 5, 1), (9, 9, 0)], "row int, col int, n int")
    assert {(r.row, r.col) for r in fr.peaks(cells).collect()} == {(0, 0), (0, 1), (5, 5)} and fr.peaks(cells.where("n < 0")).count() == 0
