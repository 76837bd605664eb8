"""What a training loop does to its rows and its loss: noise, weights that grow, smoothed losses with a stop."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType


def normal(seed: int, *key: str) -> Column:
    """A standard normal number for each key, the same over reruns and partitionings."""
    unit = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *key), F.lit(1 << 53)) + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * math.pi * unit(1))


def noisy(frames: DataFrame, channels: Sequence[str], blur: float = 0, jitter: float = 0, seed: int = 0) -> DataFrame:
    """Channels with noise: blur is a deviation for each value, jitter one for each row, which all its channels share."""
    shared = jitter * normal(seed, "clip_id", "t") if jitter else F.lit(0.0)
    own = lambda k: blur * normal(seed + k + 1, "clip_id", "t") if blur else F.lit(0.0)
    return frames.withColumns({c: F.col(c) + own(k) + shared for k, c in enumerate(channels)})


def noisy_windows(frames: DataFrame, w: int, channels: Sequence[str], scale: float = 0.8, seed: int = 0) -> DataFrame:
    """Channels with noise in proportion to their sample deviation in chunks of w rows; chunks of one row stay as they are."""
    chunk = Window.partitionBy("clip_id", F.floor(F.col("t") / w))
    return frames.withColumns({c: F.col(c) + F.coalesce(F.stddev_samp(c).over(chunk), F.lit(0.0)) * scale * normal(seed + k, "clip_id", "t") for k, c in enumerate(channels)})


def annealed(epoch: Column, start: int, length: int, form: str = "linear") -> Column:
    """A loss term's weight: 0 up to epoch `start`, then growing to 1 in `length` epochs (linear), or by a logistic curve about epoch `length` (sigmoid)."""
    if form == "linear":
        grown = F.least(F.lit(1.0), (epoch - start) / F.lit(float(length)))
    elif form == "sigmoid":
        grown = 1 / (1 + F.exp(-0.9 * (epoch - length)))
    else:
        raise ValueError(f"unknown form: {form}")
    return F.when(epoch > start, grown).otherwise(F.lit(0.0))


def smoothed(losses: DataFrame, run: str, step: str, value: str, alpha: float, patience: int = 100) -> DataFrame:
    """run, step, value, smoothed, idle, stopped for each step of each run.

    smoothed: s * (1 - alpha) + value * alpha from the run's first value on. idle: steps since it was last below all before. stopped: whether
    idle has reached patience, at this step or before. Runs are sorted by Spark and streamed: a task takes many, one after another, and holds a batch of rows and
    the state of one run, however long it is.
    """
    kind = StructType([losses.schema[run], StructField("step", LongType()), StructField("value", DoubleType()), StructField("smoothed", DoubleType()), StructField("idle", IntegerType()), StructField("stopped", BooleanType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now, least, idle, stopped = None, None, math.inf, 0, False
        for b in batches:
            if not b.num_rows:
                continue
            out = []
            for first, x in zip(_changes(b.column(0), last), b.column("value").to_numpy(zero_copy_only=False).tolist(), strict=True):
                if first:
                    now, least, idle, stopped = x, math.inf, 0, False
                else:
                    now = now * (1 - alpha) + x * alpha
                idle = 0 if now < least else idle + 1
                least, stopped = min(least, now), stopped or idle >= patience
                out.append((now, idle, stopped))
            last = b.column(0).slice(b.num_rows - 1)
            more = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.float64(), pa.int32(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [f.name for f in kind])

    d = losses.select(run, F.col(step).cast("long").alias("step"), F.col(value).cast("double").alias("value"))
    return d.repartition(run).sortWithinPartitions(run, F.asc_nulls_last("step"), "value").mapInArrow(fold, kind)


def _changes(keys: pa.Array, last: pa.Array | None) -> list[bool]:
    """Whether each key of sorted ones differs from the one before, which is `last` (one key, or None) for the first; nulls are equal."""
    before = pa.concat_arrays([keys.slice(0, 1) if last is None else last, keys.slice(0, len(keys) - 1)])
    gone = pc.xor(pc.is_null(keys), pc.is_null(before))
    out = pc.or_(gone, pc.fill_null(pc.not_equal(keys, before), False)).to_pylist()
    out[0] = out[0] or last is None
    return out
