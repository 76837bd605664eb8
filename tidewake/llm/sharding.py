"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into buckets of a size that fits in memory, by a seeded hash. Pass two shuffles each bucket by
Fisher-Yates (Spark's shuffle() function on the bucket's array) and writes it. A record's place in the whole order is its bucket's
offset plus its place in the bucket; shards are equal ranges of places, so a bucket is written to one or two of them and counts differ by one
row at most. Everything is DataFrame operations.

shuffle() draws from one generator a partition, seeded by the partition's number. So records go to partitions by number (bucket modulo PARTITIONS), each
bucket is sorted before it is shuffled, and a partition's buckets are taken in order: the result depends on the records, the seed and the
bucket's size alone, not on session settings or the order in which records arrive, and a task that is run again after its executor was lost gives
the same order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, new_folder

BUCKET = 16 << 20  # bytes of records in a bucket, about
PARTITIONS = 1 << 15  # that buckets are dealt to, at most
SPAN = 1024  # buckets whose offsets are added up in one task
SEED = 20240229


def two_pass_shuffle(df: DataFrame, size: Column, shards: int = 40, bucket_bytes: int = BUCKET, seed: int = SEED) -> DataFrame:
    """df in a seeded random order, with `shard` and `slot` (columns of these names are replaced).

    size: bytes of a record. Buckets: by a hash of all columns, so a hot key with different records is spread. Exact repeats of a row that
    would fill a quarter of a bucket are counted, and their copies dealt evenly over all buckets; fewer ones meet in one. Null keys and
    texts are values like others. An empty table gives no rows. Columns must be of types that can be ordered and hashed (no maps).
    """
    df = df.drop("shard", "slot")
    cols = [F.col(f"`{c}`") for c in df.columns]
    # the record is one column, so no name of its own can clash with ours
    placed = df.select(F.struct(*cols).alias("_r"), F.xxhash64(F.lit(seed), *cols).alias("_h"), size.cast("long").alias("_size"))
    light = placed.select("_h", "_size")
    bytes_, rows = light.agg(F.sum("_size"), F.count("*")).first()
    n = max(1, math.ceil((bytes_ or 0) / bucket_bytes))
    many = cut(light.groupBy("_h").agg(F.sum("_size").alias("_all"), F.count("*").alias("_n")).where((F.col("_n") > 1) & (F.col("_all") > bucket_bytes / 4)).select("_h"), "shard-repeats")
    spread = F.explode(F.sequence(F.lit(0), F.least(F.lit(n), F.col("_n")).cast("int") - 1))
    copies = placed.join(many, "_h", "left_semi").groupBy("_r", "_h").agg(F.count("*").alias("_n")).select("_r", "_h", "_n", spread.alias("_k"))
    copies = copies.select("_r", "_h", F.pmod(F.col("_h") + F.col("_k"), F.lit(n)).alias("_b"), F.explode(F.sequence(F.lit(1), F.floor((F.col("_n") + n - 1 - F.col("_k")) / n).cast("int")))).drop("col")
    placed = placed.join(many, "_h", "left_anti").select("_r", "_h", F.pmod("_h", F.lit(n)).alias("_b")).unionByName(copies)
    # the rows of a bucket's predecessors: within spans of buckets, then over the spans
    counts = light.join(many, "_h", "left_anti").groupBy(F.pmod("_h", F.lit(n)).alias("_b")).agg(F.count("*").alias("_n")).unionByName(copies.groupBy("_b").agg(F.count("*").alias("_n")))
    counts = counts.groupBy("_b").agg(F.sum("_n").alias("_n")).withColumn("_g", F.floor(F.col("_b") / SPAN))
    spans = counts.groupBy("_g").agg(F.sum("_n").alias("_s")).select("_g", (F.sum("_s").over(Window.orderBy("_g")) - F.col("_s")).alias("_first"))
    start = counts.join(spans, "_g").select("_b", (F.col("_first") + F.sum("_n").over(Window.partitionBy("_g").orderBy("_b")) - F.col("_n")).alias("_from"))
    # a bucket's offset travels as one more row, so that records are exchanged once
    placed = placed.select("_b", F.struct("_h", "_r").alias("_x"))
    placed = placed.withColumn("_from", F.lit(None).cast("long")).unionByName(start.select("_b", F.lit(None).cast(placed.schema["_x"].dataType).alias("_x"), "_from"))
    parts = min(n, PARTITIONS)
    dealt = placed.withColumn("_p", F.pmod("_b", F.lit(parts)).cast("int")).repartitionById(parts, F.col("_p"))
    full = dealt.groupBy("_p", "_b").agg(F.sort_array(F.collect_list("_x")).alias("_all"), F.max("_from").alias("_from")).sortWithinPartitions("_b")
    mixed = full.withColumn("_all", F.shuffle("_all", seed))
    at, q, r = F.col("_from") + F.col("_at"), rows // shards, rows % shards
    long = F.lit(r * (q + 1))  # places of the first shards, which have a row more
    shard = F.when(at < long, F.floor(at / F.lit(q + 1))).otherwise(F.lit(r) + F.floor((at - long) / F.lit(max(q, 1))))
    slot = F.when(at < long, F.pmod(at, F.lit(q + 1))).otherwise(F.pmod(at - long, F.lit(max(q, 1))))
    return mixed.select("_from", F.posexplode("_all").alias("_at", "_x")).select("_x._r.*", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, **how) -> None:
    """Write a folder for each shard; a file has a bucket's records of that shard in the order of their slots."""
    two_pass_shuffle(df, **how).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def written(df: DataFrame, **how) -> DataFrame:
    """The records with shard and slot, read from shards written to the shared folder."""
    spark: SparkSession = df.sparkSession
    path = new_folder(spark, "shards")
    write_shards(df, path, **how)
    schema = df.drop("shard", "slot").schema.add("slot", "long").add("shard", "integer")
    return spark.read.schema(schema).parquet(path)


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 16."""
    return (F.octet_length(F.coalesce(text.cast("string"), F.lit(""))) + 16).cast("long")


def digest(docs: DataFrame) -> DataFrame:
    """docs with size and text_crc32 (of UTF-8; null: as empty)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"size": size_of(F.col("text")), "text_crc32": F.crc32(text.cast("binary"))})
