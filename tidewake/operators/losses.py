"""Losses over all rows: information between neighbouring soft assignments, the nuclear term of latent vectors, and divergence from a normal prior.

What is summed over rows is a small square matrix (classes or latent dimensions); tasks add up their own part of it, and one row comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parts import PART, own, with_parts

#: Fixed value: probabilities are held to be at least this in logarithms.
LEAST = float(np.finfo(np.float64).eps)


def _rows(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _summed(parts: DataFrame) -> DataFrame:
    """i, j, value: sums of matrices given as rows of flat arrays m with k columns."""
    e = parts.select("k", F.posexplode("m").alias("at", "v")).groupBy("k", "at").agg(F.sum("v").alias("value"))
    return e.select(F.floor(F.col("at") / F.col("k")).cast("int").alias("i"), (F.col("at") % F.col("k")).cast("int").alias("j"), "value")


def joint(assigned: DataFrame, half: int, probs: str = "probs", part: int = PART) -> DataFrame:
    """i, j, value: the joint distribution of the classes of rows at most `half` apart in a sequence, symmetric, its sum 1.

    assigned: clip_id (a sequence), t, probs (an array, a probability a class). Every lag from -half to half counts alike; beyond a sequence's ends there is
    nothing. Long sequences are dealt in parts with `half` rows around them, so none has to be in one task.
    """

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("t")
        x, at, mine = _rows(t.column("x").combine_chunks()), t.column("t").to_numpy(), t.column("own").to_numpy()
        total = np.concatenate((np.zeros((1, x.shape[1])), np.cumsum(x, 0)))
        low, high = np.searchsorted(at, at - half), np.searchsorted(at, at + half, "right")
        m = (total[high] - total[low])[mine].T @ x[mine]  # of each row's neighbours, and of the row
        return pa.table({"k": pa.array([x.shape[1]], pa.int32()), "m": pa.array([m.ravel().tolist()], pa.list_(pa.float64()))})

    d = with_parts(assigned.select("clip_id", "t", F.col(probs).cast("array<double>").alias("x")), half, half, part).withColumn("own", own(part))
    s = _summed(d.groupBy("clip_id", "_part").applyInArrow(run, "k int, m array<double>"))
    whole = s.agg(F.sum("value").alias("_all"))  # one row
    flipped = s.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")
    both = s.unionByName(flipped).groupBy("i", "j").agg(F.sum("value").alias("value"))
    return both.crossJoin(F.broadcast(whole)).select("i", "j", (F.col("value") / (2 * F.col("_all"))).alias("value"))


def information_loss(assigned: DataFrame, half: int, probs: str = "probs", weight: float = 1.0, part: int = PART) -> DataFrame:
    """One row: loss, the negative mutual information of classes at most `half` rows apart, with marginals weighted by `weight`; and loss_plain, with weight 1."""
    p = joint(assigned, half, probs, part)
    marginal = p.groupBy("i").agg(F.sum("value").alias("m"))  # a row a class; the matrix is symmetric, so rows and columns have the same
    d = p.join(F.broadcast(marginal.withColumnRenamed("m", "mi")), "i").join(F.broadcast(marginal.select(F.col("i").alias("j"), F.col("m").alias("mj"))), "j")
    log = lambda c: F.log(F.greatest(F.col(c), F.lit(LEAST)))
    v = F.greatest(F.col("value"), F.lit(LEAST))
    of = lambda w: F.sum(-v * (F.log(v) - w * log("mi") - w * log("mj")))
    return d.agg(of(weight).alias("loss"), of(1.0).alias("loss_plain"))


def gram(latent: DataFrame, column: str = "latent") -> DataFrame:
    """i, j, value: the sum of products of latent dimensions i and j over all rows, over the number of rows. Nothing is shuffled but a matrix a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = _rows(b.column("x"))
                m = np.append((x.T @ x).ravel(), len(x))
                total = m if total is None else total + m
        if total is not None:
            k = int(np.sqrt(len(total) - 1))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[:-1].tolist()], pa.list_(pa.float64())), pa.array([int(total[-1])])], ["k", "m", "n"])

    parts = latent.select(F.col(column).cast("array<double>").alias("x")).where(F.col("x").isNotNull()).mapInArrow(run, "k int, m array<double>, n long")
    e = parts.select("k", "n", F.posexplode("m").alias("at", "v")).groupBy("k", "at").agg((F.sum("v") / F.sum("n")).alias("value"))
    return e.select(F.floor(F.col("at") / F.col("k")).cast("int").alias("i"), (F.col("at") % F.col("k")).cast("int").alias("j"), "value")


def nuclear_loss(latent: DataFrame, terms: int, weight: float = 1.0, column: str = "latent") -> float:
    """weight times the sum of square roots of the `terms` largest singular values of the rows' Gram matrix over their number.

    The matrix of all rows by all rows has the same singular values, but for zeros, as the small one by dimensions, whose spectrum is found on the driver.
    """
    cells = gram(latent, column).collect()  # dimensions squared
    if not cells:
        return 0.0
    m = np.zeros((max(c.i for c in cells) + 1,) * 2)
    for c in cells:
        m[c.i, c.j] = c.value
    return float(weight * np.sqrt(np.maximum(np.linalg.eigvalsh(m)[::-1][:terms], 0)).sum())


def divergence(latent: DataFrame, mean: str = "mu", log_variance: str = "logvar") -> DataFrame:
    """One row: loss, the mean over rows and dimensions of -(1 + v - m^2 - e^v) / 2 for means m and logarithms of variances v (arrays)."""
    each = F.zip_with(F.col(mean).cast("array<double>"), F.col(log_variance).cast("array<double>"), lambda m, v: 1 + v - m * m - F.exp(v))
    return latent.agg((-0.5 * F.sum(F.aggregate(each, F.lit(0.0), lambda s, x: s + x)) / F.sum(F.size(mean))).alias("loss"))

