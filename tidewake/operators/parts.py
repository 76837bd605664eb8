"""Clips in parts: stretches of a clip with the rows around them, so that what looks a bounded way around each row needs no whole clip in one task.

t counts a clip's rows from 0 without gaps, as with_time() and the readers of files make it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 1 << 17  # rows of a part


def with_parts(frames: DataFrame, before: int, after: int, size: int = PART) -> DataFrame:
    """frames with `_part`: each row in the part floor(t / size) of its clip, and again in each part that it is at most `before` rows ahead of the first
    row of, or `after` rows behind the last one. own() tells them apart. Parts beyond a clip's end have no rows of their own."""
    first, last = F.greatest(F.floor((F.col("t") - after) / size), F.lit(0)), F.floor((F.col("t") + before) / size)
    return frames.withColumn("_part", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def own(size: int = PART):
    """Whether a row lies in its part, not around it."""
    return F.floor(F.col("t") / size) == F.col("_part")
