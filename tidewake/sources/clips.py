"""Recordings, metadata, predictions and results in files.

A clip file has no header and one row a sample, and its row order is time. Files are read in byte ranges, as Spark's line reader cuts them (a line belongs to the
range in which it begins); lines are numbered in their range, and ranges by a sum over the line counts of those before, a row a range. So a
file may be far larger than a task. ingest() writes the result once as Parquet, which all other operators read with column and partition pruning.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewake.functions.expr import clip_of
from tidewake.plans.config import ID_COLUMNS, Metadata


def read_yaml(spark: SparkSession, path: str) -> dict[str, Any]:
    """A YAML (or JSON) document, read by Spark, so from any store."""
    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def write_document(spark: SparkSession, document: Mapping[str, Any], path: str) -> None:
    """A settings or result document as JSON, which is YAML too."""
    spark.createDataFrame([(json.dumps(document, indent=1, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def metadata(spark: SparkSession, path: str) -> Metadata:
    return Metadata.of(read_yaml(spark, path))


def numbered_lines(spark: SparkSession, files: str) -> DataFrame:
    """clip_id, t, line: the lines of text files in order, from 0; empty lines count but are left out."""
    meta = [F.col(f"_metadata.{c}") for c in ("file_path", "file_block_start")]
    lines = spark.read.text(files).select(clip_of(F.col("_metadata.file_name")).alias("clip_id"), meta[0].alias("_file"), meta[1].alias("_range"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    counts = lines.groupBy("_file", "_range").agg(F.count("*").alias("_n"))
    before = counts.select("_file", "_range", (F.sum("_n").over(Window.partitionBy("_file").orderBy("_range")) - F.col("_n")).alias("_before"))  # a row a range
    own = F.row_number().over(Window.partitionBy("_file", "_range").orderBy("_at")) - 1
    numbered = lines.withColumn("_own", own).join(before, ["_file", "_range"])
    return numbered.where("line <> ''").select("clip_id", (F.col("_before") + F.col("_own")).cast("long").alias("t"), "line")


def read_clips(spark: SparkSession, folder: str, meta: Metadata) -> DataFrame:
    """clip_id, t, channels, individual_id, label. Fails on a line with a missing or empty value."""
    names = list(meta.clip_column_names)
    v = F.split("line", ",")
    lines = numbered_lines(spark, f"{folder}/*.csv").withColumn("v", F.when(F.size(v) == len(names), v).otherwise(F.raise_error(F.concat(F.lit("wrong number of values in clip "), "clip_id"))))
    cols = []
    for k, n in enumerate(names):
        x = F.nullif(F.trim(F.col("v")[k]), F.lit("")).cast("double")
        x = F.coalesce(x, F.raise_error(F.concat(F.lit(f"no {n} in clip "), "clip_id")).cast("double"))
        cols.append((x.cast("int") if n in ID_COLUMNS else x).alias(n))
    return lines.select("clip_id", "t", *cols)


def ingest(spark: SparkSession, folder: str, meta: Metadata, path: str) -> DataFrame:
    """Write the clips as Parquet in order of clip and t and read them again."""
    _write_clips(read_clips(spark, folder, meta), path)
    return spark.read.parquet(path)


def clip_table(spark: SparkSession, meta: Metadata) -> DataFrame:
    return spark.createDataFrame(meta.clip_rows(), "clip_id string, individual_id int, fold int")


def label_table(spark: SparkSession, meta: Metadata) -> DataFrame:
    return spark.createDataFrame(list(enumerate(meta.label_names)), "label_idx int, label_name string")


def with_individual(frames: DataFrame, clips: DataFrame) -> DataFrame:
    """individual_id from the metadata's map."""
    return frames.drop("individual_id").join(clips.select("clip_id", "individual_id"), "clip_id")


def _write_clips(rows: DataFrame, path: str) -> None:
    """A file a task, each with many clips in order, whose extents of clip_id in row groups let a reader skip; a folder a clip would be as many files as there are clips."""
    rows.repartition("clip_id").sortWithinPartitions("clip_id", "t").write.mode("overwrite").parquet(path)


def write_predictions(predictions: DataFrame, path: str) -> None:
    _write_clips(predictions.select("clip_id", "t", "pred"), path)


def export_predictions(predictions: DataFrame, path: str) -> None:
    """A folder for each clip with one headerless column of predictions in the order of t."""
    p = predictions.select("clip_id", "t", F.col("pred").cast("string").alias("value"))
    p.repartition("clip_id").sortWithinPartitions("clip_id", "t").select("clip_id", "value").write.mode("overwrite").partitionBy("clip_id").text(path)


def read_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """clip_id, t, pred of headerless one-column files named as the clips."""
    return numbered_lines(spark, f"{folder}/*.csv").select("clip_id", "t", F.col("line").cast("double").cast("int").alias("pred"))


def align(frames: DataFrame, predictions: DataFrame) -> DataFrame:
    """frames with pred. Fails if a clip lacks predictions or has another number of them."""
    n = frames.groupBy("clip_id").agg(F.count("*").alias("n")).join(predictions.groupBy("clip_id").agg(F.count("*").alias("m")), "clip_id", "left")
    if bad := n.where("m IS NULL OR n <> m").take(5):
        raise ValueError(f"predictions are missing or of another length: {[tuple(r) for r in bad]}")
    return frames.join(predictions.select("clip_id", "t", "pred"), ["clip_id", "t"])


def write_results(tables: Mapping[str, DataFrame], path: str, **keys: Any) -> None:
    """Each table of an evaluation below path, with the run's keys (experiment, fold, ...) as columns."""
    for name, table in tables.items():
        table.withColumns({k: F.lit(v) for k, v in keys.items()}).write.mode("append").parquet(f"{path}/{name}")


def read_results(spark: SparkSession, path: str, name: str, **keys: Any) -> DataFrame:
    df = spark.read.parquet(f"{path}/{name}")
    for k, v in keys.items():
        df = df.where(F.col(k) == v)
    return df


def track(frames: DataFrame, clip_id: Any, begin: int, end: int, channels: Sequence[str]) -> DataFrame:
    """Rows of a clip for a plot of its signals, labels and predictions."""
    return frames.where((F.col("clip_id") == clip_id) & F.col("t").between(begin, end)).select("t", *channels, "label", "pred").orderBy("t")
