"""Scalar and aggregate expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column, empty: float) -> Column:
    """top / bottom; `empty` where bottom is 0."""
    return F.when(bottom == 0, F.lit(float(empty))).otherwise(top.cast("double") / F.when(bottom == 0, 1).otherwise(bottom).cast("double"))


def path_key(clip: str = "clip_id") -> Column:
    """The order of clip files by name; '-' < '.' < '_', so it isn't always the order of clip ids."""
    return F.concat(F.col(clip).cast("string"), F.lit(".csv"))


def clip_of(path: Column) -> Column:
    """A clip's id: its file's name up to the first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def norm(*axes: str) -> Column:
    return F.sqrt(sum((F.col(a) * F.col(a) for a in axes), F.lit(0.0)))


def inclination(z: Column, q: Column, eps: float = 1e-12) -> Column:
    return F.acos(z / (q + eps))


def azimuth(y: Column, z: Column, eps: float = 1e-12) -> Column:
    return F.atan(y / (z + eps))


def shift_unknown(pred: Column) -> Column:
    """Supervised predictions of the unknown class 0 count as class 1."""
    return F.when(pred == 0, 1).otherwise(pred)


def steps_factor(rows: int, steps: int, batch: int) -> int:
    """By how much epochs shrink so that 100 of them take `steps` steps."""
    return int(100 * rows / (steps * batch))


def batch_cap(n_batches: int, factor: int) -> int:
    return 1 + n_batches // factor
