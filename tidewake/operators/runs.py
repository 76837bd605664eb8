"""Experiments: one run from its settings to its tables, a sweep of runs with resume, the best one on the other folds, and a summary.

Runs are a short list on the driver; the work of each is Spark jobs. A run's folder holds config, model, predictions, individual, overall, labels, confusion, ... and
last of all `done`, so a run that was cut off is run again.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.plans import config
from tidewake.sources import clips as files

from . import crossval, evaluate, models, signal
from . import frames as fr
from .classic import Classic

log = logging.getLogger(__name__)
CLASSIC = frozenset({"rf", "dt", "svm"})


def _done(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/done")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def model_inputs(frames: DataFrame, meta: config.Metadata, settings: Mapping[str, Any]) -> tuple[DataFrame, list[str], dict[str, Any]]:
    """The rows that a model sees (clip_id, t, individual_id, label, split, channels), its channels, and a classic model's parts of acceleration.

    Channels are the wanted ones in the schema's order; with a cut-off, acceleration is split into a static and a dynamic part; with wavelets (which see the
    channels as they are, before any split) there is one for each channel and period. Nothing is scaled here: classic models scale acceleration where
    normalize is set, a hidden Markov model and k-means scale by their training rows.
    """
    own, acc = settings["model_config"], []
    channels = meta.channels(settings.get("input_vars"))
    keys = [c for c in ("clip_id", "t", "individual_id", "label", "split") if c in frames.columns]
    rows, parts = frames.select(*keys, *channels), {"dynamic_only": meta.dynamic_acc_only}
    if own.get("wavelet_transform") or settings["model"] == "umapper":
        waves = signal.wavelets(rows, channels, meta.sr, own["n_wavelets"], own.get("C_min"), own.get("C_max") or 100, own["morlet_w"], bool(own.get("per_channel_normalize")))
        names = [f"wave{k}" for k in range(len(channels) * own["n_wavelets"])]
        rows = rows.select(*keys).join(waves, ["clip_id", "t"])
        return rows.select(*keys, *(F.col("values")[k].alias(c) for k, c in enumerate(names))), names, parts
    if cut := settings["static_acc_cutoff_freq"]:
        acc = [c for c in channels if "Acc" in c]
        rows = signal.static_dynamic(rows, channels, cut, meta.sr)
        parts |= {"static": {c: f"{c}_static" for c in acc}, "dynamic": {c: f"{c}_dynamic" for c in acc}}
    return rows, [y for c in channels for y in ((f"{c}_static", f"{c}_dynamic") if c in acc else (c,))], parts


def training_rows(rows: DataFrame, settings: Mapping[str, Any]) -> DataFrame:
    """The rows of split train that a model without labels is fitted on: with downsample n, k-means and models on wavelets take every n-th row of each clip,
    a Gaussian mixture every n-th of all clips stacked, a hidden Markov model on plain channels all."""
    train, own = rows.where("split = 'train'"), settings["model_config"]
    step, name = int(own.get("downsample") or 1), config.implementation(settings["model"])
    if step <= 1 or name == "hmm" and not own.get("wavelet_transform"):
        return train
    return fr.every_nth_overall(train, step).drop("index") if name == "gmm" else fr.every_nth(train, step)


def _vectors(rows: DataFrame, channels: Sequence[str]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    keys = [c for c in ("clip_id", "t", "split", "label") if c in rows.columns]
    return rows.select(*keys, array_to_vector(F.array(*(F.col(f"`{c}`").cast("double") for c in channels))).alias("features"))


def fit_model(frames: DataFrame, meta: config.Metadata, settings: Mapping[str, Any]) -> Classic | models.BehaviourModel:
    """The model of the settings, fitted on the rows of frames whose split is train."""
    name, seed, own = config.implementation(settings["model"]), settings["seed"], settings["model_config"]
    rows, channels, parts = model_inputs(frames, meta, settings)
    if name in CLASSIC:
        plain = channels if own.get("wavelet_transform") else meta.channels(settings.get("input_vars"))
        return Classic(name, plain, meta.known, meta.sr, own, seed, settings["balance_classes"], **parts).fit(rows.where("split = 'train'"))
    return models.model(name, _clusters(meta, settings), seed, **own).fit(training_rows(_vectors(rows, channels), settings))


def _clusters(meta: config.Metadata, settings: Mapping[str, Any]) -> int:
    return config.cluster_count(len(meta.known), not settings["unsupervised"], len(meta.label_names), settings.get("num_clusters"))


def predict_model(model: Classic | models.BehaviourModel, frames: DataFrame, meta: config.Metadata, settings: Mapping[str, Any]) -> DataFrame:
    """clip_id, t, pred of every row of frames."""
    rows, channels, _ = model_inputs(frames, meta, settings)
    return model.predict(rows if isinstance(model, Classic) else _vectors(rows, channels)).select("clip_id", "t", "pred")


def predictions(frames: DataFrame, meta: config.Metadata, settings: Mapping[str, Any], save: str | None = None) -> tuple[DataFrame, int | None]:
    """clip_id, t, pred of every row of frames (with split), and the number of clusters of a model that takes no labels. Fits on split train.

    save: a folder that gets the model, and below it the tables on its fit.
    """
    model = fit_model(frames, meta, settings)
    if save:
        model.save(f"{save}/model", frames.sparkSession)
        for name, table in getattr(model, "diagnostics", lambda _: {})(frames.sparkSession).items():
            table.write.mode("overwrite").parquet(f"{save}/{name}")
    return predict_model(model, frames, meta, settings), _clusters(meta, settings) if settings["unsupervised"] else None


def predict_saved(spark: SparkSession, folder: str, frames: DataFrame, meta: config.Metadata) -> DataFrame:
    """clip_id, t, pred of other clips (clip_id, t, channels) by the model of a run's folder; with files.read_clips(), of clip files."""
    settings = files.read_yaml(spark, f"{folder}/config")
    kind = Classic if config.implementation(settings["model"]) in CLASSIC else models
    return predict_model(kind.load(f"{folder}/model", spark), frames, meta, settings)


def run(frames: DataFrame, meta: config.Metadata, settings: Mapping[str, Any], path: str, resume: bool = False) -> str:
    """Run one experiment on frames (clip_id, t, individual_id, label, channels) and write its folder below path; gives that folder.

    Individuals of the evaluation are those of the metadata. With resume, a run that is done is not run again.
    """
    spark = frames.sparkSession
    full = config.with_defaults(settings)
    folder = f"{path}/{full['experiment_name']}"
    if resume and _done(spark, folder):
        return folder
    clips = files.clip_table(spark, meta)
    folds = config.folds(meta.n_folds, full.get("test_folds"), full["low_data_setting"], full.get("val_folds"))
    told = fr.assign_split(fr.checked(frames, clips), clips, folds)
    files.write_document(spark, full | {f"{k}_folds": v for k, v in folds.items()}, f"{folder}/config")
    pred, clusters = predictions(told, meta, full, folder)
    files.write_predictions(pred, f"{folder}/predictions")
    pred = spark.read.parquet(f"{folder}/predictions").select(F.col("clip_id").cast("string").alias("clip_id"), "t", "pred")
    judged = files.with_individual(files.align(told, pred), clips)
    targets = spark.createDataFrame(list(meta.mean_dur_sec_by_individual.items()), "individual_id int, mean_dur_sec double") if meta.mean_dur_sec_by_individual else None
    tables = evaluate.evaluate(judged, meta.known, clusters, meta.unknown, meta.sr, meta.mean_overall_dur_sec or 1.0, targets)
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    files.write_document(spark, {"experiment_name": full["experiment_name"]}, f"{folder}/done")
    return folder


def run_config(spark: SparkSession, config_path: str, frames: DataFrame, meta: config.Metadata, resume: bool = False) -> str:
    """run() on a settings document (YAML or JSON), which names the folder in output_parent_dir."""
    settings = files.read_yaml(spark, config_path)
    return run(frames, meta, settings, settings["output_parent_dir"], resume)


def run_all(frames: DataFrame, meta: config.Metadata, runs: Sequence[Mapping[str, Any]], path: str, resume: bool = False, at_once: int = 2, failed: dict[str, str] | None = None, seconds: float | None = None) -> dict[str, str]:
    """Run settings documents, `at_once` side by side, each in a scheduler pool of its own. Gives the folders of those that are done, by experiment name.

    A run that fails, or takes over `seconds`, is logged and left out (failed gets its name and error); its jobs carry a tag, by which they are cancelled. So
    are all jobs if the caller is interrupted. Pools share the cluster evenly where spark.scheduler.mode is FAIR.
    """
    context = frames.sparkSession.sparkContext
    todo = [r for r in runs if not r.get("skipped")]
    tags = {r["experiment_name"]: f"run-{uuid.uuid4().hex}" for r in todo}
    failed, began = {} if failed is None else failed, {}

    def one(settings: Mapping[str, Any]) -> str:
        name = settings["experiment_name"]
        began[name] = time.monotonic()
        context.setLocalProperty("spark.scheduler.pool", tags[name])
        context.addJobTag(tags[name])
        try:
            return run(frames, meta, settings, path, resume)
        finally:
            context.removeJobTag(tags[name])
            context.setLocalProperty("spark.scheduler.pool", None)

    out: dict[str, str] = {}
    pool = ThreadPoolExecutor(max(1, at_once))
    futures = {pool.submit(one, r): r["experiment_name"] for r in todo}
    try:
        left = set(futures)
        while left:
            ended, left = wait(left, timeout=None if seconds is None else 1.0, return_when=FIRST_COMPLETED)
            for f in ended:
                if e := f.exception():  # one bad point of a grid must not end the sweep
                    failed.setdefault(futures[f], str(e).partition("\n")[0][:500])
                    log.error("experiment %s failed", futures[f], exc_info=e)
                else:
                    out[futures[f]] = f.result()
            for f in left if seconds is not None else ():
                if (at := began.get(futures[f])) is not None and time.monotonic() - at > seconds:
                    failed.setdefault(futures[f], f"took over {seconds:g} seconds")
                    context.cancelJobsWithTag(tags[futures[f]])
    except BaseException:
        pool.shutdown(wait=False, cancel_futures=True)
        for tag in tags.values():
            context.cancelJobsWithTag(tag)
        raise
    pool.shutdown()
    return {r["experiment_name"]: out[r["experiment_name"]] for r in todo if r["experiment_name"] in out and r["experiment_name"] not in failed}


def table_of(spark: SparkSession, folders: Mapping[str, str], name: str) -> DataFrame | None:
    """A table of all runs, with their experiment's name; None without runs."""
    out = None
    for k, f in folders.items():
        d = spark.read.parquet(f"{f}/{name}").withColumn("experiment", F.lit(k))
        out = d if out is None else out.unionByName(d)
    return out


def sweep(frames: DataFrame, meta: config.Metadata, runs: Sequence[Mapping[str, Any]], path: str, resume: bool = False, at_once: int = 2) -> dict[str, Any]:
    """Write and run a sweep's settings; gives those of the run with the highest mean macro F1 over test individuals, of equals the first one.

    The document `summary` names what was done, left out and failed, and why.
    """
    spark, failed = frames.sparkSession, {}
    for r in runs:
        files.write_document(spark, r, f"{path}/settings/{r['experiment_name']}")
    done = run_all(frames, meta, runs, path, resume, at_once, failed)
    files.write_document(spark, {"done": sorted(done), "failed": failed, "skipped": {r["experiment_name"]: r["skipped"] for r in runs if r.get("skipped")}}, f"{path}/summary")
    if not done:
        raise ValueError(f"no run of the sweep succeeded: {failed}")
    number = {r["experiment_name"]: i for i, r in enumerate(runs)}
    scores = table_of(spark, done, "individual").where("split = 'test'").join(F.broadcast(spark.createDataFrame(list(number.items()), "experiment string, config_id long")), "experiment")
    return dict(runs[crossval.best(scores).first()["config_id"]])


def cross_validate(frames: DataFrame, meta: config.Metadata, runs: Sequence[Mapping[str, Any]], path: str, resume: bool = False, at_once: int = 2) -> dict[str, DataFrame]:
    """Sweep on fold 0, run the best settings on all other folds, and write the tables over these folds below path/summary, which it gives.

    scores: means and deviations by split over all individuals; individualised: of F1 under each individual's own cluster map (models without labels);
    labels: counts by split and label, summed; confusion: counts and shares by split, summed.
    """
    spark = frames.sparkSession
    best = sweep(frames, meta, runs, f"{path}/hyperparameter_selection", resume, at_once)
    done = run_all(frames, meta, config.final_runs(best, meta.n_folds), f"{path}/final", resume, at_once)
    if len(done) < meta.n_folds - 1:
        raise ValueError(f"folds failed; done: {sorted(done)}")
    out = {"scores": crossval.summary(table_of(spark, done, "individual")), "confusion": crossval.summed_confusion(table_of(spark, done, "confusion"), ["split"]), "labels": crossval.summed_labels(table_of(spark, done, "labels"))}
    if config.with_defaults(best)["unsupervised"]:
        out["individualised"] = crossval.individualised(table_of(spark, done, "individualised"))
    for name, table in out.items():
        table.write.mode("overwrite").parquet(f"{path}/summary/{name}")
    files.write_document(spark, {"best": best}, f"{path}/summary/settings")
    return {name: spark.read.parquet(f"{path}/summary/{name}") for name in out}
