"""Five stages that turn documents into shuffled training shards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import decontaminate, mixing, ngram_join, quality_rules, sharding
from tidewake.llm.common import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: No stage's rows can be given by SQL: the rules are learned, the links are by hashes, the sampling and the shuffle are seeded.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base or the learned rules reject.

    Null and empty texts have no words, so they go. Repeated rows are judged alike; rows without a doc_id are judged too, they only can't be
    labelled. An empty table, or labels of one kind only, leave the base alone to judge. Columns other than COLUMNS are not passed on.
    """
    rules = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = quality_rules.quality(docs.select(*COLUMNS), rules).select(*COLUMNS, "kept")
    # Catalyst would push a filter on what was computed below each step, and compute them many times over; not past a row's number
    return judged.withColumn("_row", F.monotonically_increasing_id()).where("kept AND _row >= 0").select(*COLUMNS)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each component of near duplicates the row with the smallest doc_id, once; rows are told by doc_id and text, so different texts
    under one doc_id are judged each.

    Rows without an id stay, and so do texts without words, which are linked with nothing (repeats of one such row are one). Ties: of rows with
    the smallest doc_id in a component, one stays. An empty table gives no rows. Columns other than COLUMNS are not passed on.
    """
    docs = docs.select(*COLUMNS)
    named = docs.where("doc_id IS NOT NULL").withColumn("_row", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    found = ngram_join.jaccard_components(named.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id").distinct()
    least = named.select("_row", "doc_id").join(found, "_row").groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("x"))
    kept = named.join(least.select("x._row"), "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)
    return kept.unionByName(docs.where("doc_id IS NULL").select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, a long piece of one, or its paraphrase.

    Rows are judged by doc_id, so all rows of an id go if one leaks; rows without an id stay, as do null and empty texts. An empty table on
    either side drops nothing. Columns other than COLUMNS are not passed on.
    """
    return decontaminate.without_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix does, repeats as rows of their own.

    A null source is a source of its own; null and empty texts have no words and are taken as their source's ratio says; rows of one id are
    taken alike; rows without an id stay once. An empty table gives no rows. Columns other than COLUMNS are not passed on.
    """
    return mixing.repeat(docs.select(*COLUMNS)).select(*COLUMNS)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shuffle all that is left into 40 shards: COLUMNS with shard and slot.

    Nulls and repeated rows are rows like others; an empty table gives no rows; columns other than COLUMNS are not passed on.
    """
    return sharding.two_pass_shuffle(docs.select(*COLUMNS), sharding.size_of(F.col("text")), shards=40)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over all documents; each but the last is written to the shared folder and read again."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        df = stage(spark, df, sf_dir)
        df = cut(df, f"stage{k}") if k < len(STAGES) - 1 else df
    return df
