"""What the operators of this subpackage share: the folder all executors see, and cuts in lineage."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20
#: White space between words, as a regular expression class body (fixed values).
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset and all runs on one machine (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def bound_batches(spark: SparkSession) -> None:
    """Batches sent to Python hold BATCH_ROWS rows or BATCH_BYTES bytes at most, since texts are long; what one row needs is always sent."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def cut(df: DataFrame, name: str, group: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again: later stages, and those rerun after a lost executor, start from there.

    group: bytes of a row group, about, for rows of megabytes. Parquet's writer looks at its size after 100 rows only unless told otherwise, and what
    is in a group is in memory when written and when read.
    """
    bound_batches(df.sparkSession)
    gc.collect()  # frees what no variable holds, so that Spark removes shuffle files of finished steps; else they stay until the driver's heap fills
    df.sparkSession._jvm.System.gc()
    path = new_folder(df.sparkSession, name)
    sizes = {"parquet.block.size": group, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1} if group else {}
    df.write.options(**sizes).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Remove the files of a table made by cut() that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast: its rows grow with the input, and a broadcast table is built whole, several times its files' size, on the driver."""
    return df.hint("merge")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text: Column) -> Column:
    """How many words a text has; null has none."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " "))
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.translate(t, " ", "")) + 1).cast("long")
