"""The folder that driver and executors share, and cuts in lineage for loops whose next round reads the last one several times."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset and all runs on one machine (tests), one of our own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if context.master.split("[")[0] != "local":
                raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there."""
    shared(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read from it. Unlike a checkpoint it has the size of its files for the planner: a checkpoint of a join keeps the
    join's estimate, the product of its inputs' ones, whose digits multiply in each round of a long loop."""
    path = new_folder(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Removes the files of tables that stored() made and nothing reads any more."""
    for path, spark in {(f.rsplit("/", 1)[0], t.sparkSession) for t in tables for f in t.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def replaced(df: DataFrame, *before: DataFrame) -> DataFrame:
    """stored(df), for a loop; then the tables `before` are removed. First shuffle files of finished rounds are: Spark removes them when the driver's JVM
    collects what refers to them, which a heap that doesn't fill never does, so each round's files would stay until the end."""
    gc.collect()
    df.sparkSession._jvm.System.gc()
    kept = stored(df)
    removed(*before)
    return kept


ROWS, MANY = 1 << 13, 1 << 17  # rows of a training partition, at least and (where there are more than the cluster has cores) at most, about


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df computed once and dealt anew by keys, in their order, for a fit that passes over it many times. Partitions follow the number of rows, not the clips or the
    session's shuffle partitions: one for ROWS rows, as many as there are cores at most, until these have MANY rows each. A pass over few rows is few tasks, one over many rows keeps all cores."""
    kept = stored(df)
    n = kept.count()
    parts = min(-(-n // ROWS), max(df.sparkSession.sparkContext.defaultParallelism, -(-n // MANY)))
    even = kept.repartition(max(1, parts), *keys)
    return cut(even.sortWithinPartitions(*keys) if keys else even)
