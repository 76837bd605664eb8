"""Signal operators on recordings: filters, normalisation, wavelets, whitening.

A filter or a wavelet sees a bounded way around each row, so clips are dealt in parts with the rows around them (overlap-save): a clip spans tasks, and a
task holds one part. Ends of a clip are told from ends of a part by the rows that are there. Normalisations are aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .features import triads
from .parts import PART, with_parts


def taps(n: int, cut: float) -> np.ndarray:
    """n + 1 taps (n even) of a Hamming-windowed high-pass; cut relative to Nyquist, gain 1 at Nyquist."""
    k = np.arange(n + 1)
    m = k - n / 2
    h = (np.sinc(m) - cut * np.sinc(cut * m)) * (0.54 - 0.46 * np.cos(2 * np.pi * k / n))
    return h / (h * np.cos(np.pi * m)).sum()


def high_pass(x: np.ndarray, n: int, cut: float) -> np.ndarray:
    """The part of x above the cut-off, without delay. Beyond its ends x is mirrored; the farthest place on the left counts as 0."""
    n = n // 2 * 2
    half = n // 2
    if len(x) <= half:
        raise ValueError("the clip is shorter than half the filter")
    left = np.concatenate(([0.0], x[1:half][::-1])) if half else x[:0]
    padded = np.concatenate((left, x, x[-2 : -half - 2 : -1]))
    size = 1 << (len(padded) + n).bit_length()
    if n <= 64:
        return np.convolve(padded, taps(n, cut), "valid")
    return np.fft.irfft(np.fft.rfft(padded, size) * np.fft.rfft(taps(n, cut), size), size)[n : n + len(x)]


def high_pass_part(x: np.ndarray, begin: int, end: int, first: bool, last: bool, n: int, cut: float) -> np.ndarray:
    """high_pass() of the rows begin .. end of a clip, from x, which holds n // 2 rows more on either side; up to the clip's begin (first) or end (last)."""
    n = n // 2 * 2
    half = n // 2
    if first and last and len(x) <= half:
        raise ValueError("the clip is shorter than half the filter")
    if first:
        x, begin, end = np.concatenate(([0.0] if half else [], x[1:half][::-1], x)), begin + half, end + half
    if last:
        x = np.concatenate((x, x[-2 : -half - 2 : -1]))
    x = x[begin - half : end + half]
    if n <= 64:
        return np.convolve(x, taps(n, cut), "valid")
    size = 1 << (len(x) + n).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(taps(n, cut), size), size)[n : n + end - begin]


def filter_length(cut_hz: float, sr: float) -> int:
    return 5 * round(sr / cut_hz)


def static_dynamic(frames: DataFrame, channels: Sequence[str], cut_hz: float, sr: float) -> DataFrame:
    """For each accelerometer channel c, columns c_static and c_dynamic (which sum to it) instead of c; frames as they are if the cut-off is 0."""
    if not cut_hz:
        return frames
    return filtered(frames, channels, filter_length(cut_hz, sr), cut_hz / (sr / 2))


def filtered(frames: DataFrame, channels: Sequence[str], n: int, cut: float, part: int = PART) -> DataFrame:
    """static_dynamic() by a filter of length n and a cut-off relative to Nyquist."""
    acc = [c for c in channels if "Acc" in c]
    half, fields = n // 2, []
    for f in frames.schema.fields:
        fields += [StructField(f"{f.name}_{p}", DoubleType()) for p in ("static", "dynamic")] if f.name in acc else [f]

    def split(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t = pdf["t"].to_numpy()
        begin, end = np.searchsorted(t, (key[1] * part, (key[1] + 1) * part))
        out = pdf.iloc[begin:end].copy()
        if begin < end:
            # rows that a clip's mirrored end needs are there, as the part holds half a filter's rows beyond its own
            last = t[-1] < (key[1] + 1) * part + half
            for c in acc:
                x = pdf[c].to_numpy(float)
                y = high_pass_part(x, int(begin), int(end), t[0] == 0, bool(last), n, cut)
                out[f"{c}_static"], out[f"{c}_dynamic"] = x[begin:end] - y, y
        else:
            out = out.reindex(columns=[f.name for f in fields])
        return out[[f.name for f in fields]]

    return with_parts(frames, half + 1, half + 1, part).groupBy("clip_id", "_part").applyInPandas(split, StructType(fields))


def scale_acceleration(frames: DataFrame, channels: Sequence[str], parts: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Each accelerometer triad over its clip's mean field strength.

    parts: the columns that a channel was split into and that sum to it. All are divided by the whole channel's field strength, so that it doesn't matter
    whether a clip is split before it is scaled.
    """
    acc, parts = [c for c in channels if "Acc" in c], parts or {}
    if len(acc) % 3:
        raise ValueError("accelerometer channels must come in threes")
    clip, d = Window.partitionBy("clip_id"), frames
    columns = {a: list(parts.get(a, [a])) for a in acc}
    for axes in triads(acc):
        whole = [sum((F.col(c) for c in columns[a][1:]), F.col(columns[a][0])) for a in axes]
        d = d.withColumn("_field", F.avg(F.sqrt(sum((x * x for x in whole), F.lit(0.0)))).over(clip) + 1e-6)
        d = d.withColumns({c: F.col(c) / F.col("_field") for a in axes for c in columns[a]})
    return d.drop("_field")


def z_clip(frames: DataFrame, channels: Sequence[str], eps: float = 1e-6) -> DataFrame:
    """Channels less their clip's mean over its population deviation."""
    clip = Window.partitionBy("clip_id")
    return frames.withColumns({c: (F.col(c) - F.avg(c).over(clip)) / (F.stddev_pop(c).over(clip) + eps) for c in channels})


def moments(frames: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation of each channel; fitted on train, applied by z_by()."""
    return frames.agg(*(f(c).alias(f"{c}_{n}") for c in channels for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def z_by(frames: DataFrame, fitted: DataFrame, channels: Sequence[str]) -> DataFrame:
    d = frames.crossJoin(F.broadcast(fitted))  # one row
    d = d.withColumns({c: (F.col(c) - F.col(f"{c}_mean")) / F.nullif(F.col(f"{c}_std"), F.lit(0.0)) for c in channels})
    return d.select(*frames.columns)


def periods(n: int, shortest: float, longest: float) -> np.ndarray:
    return shortest * 2 ** (np.arange(n) * np.log2(longest / shortest) / (n - 1)) if n > 1 else np.array([shortest])


def widths(sr: float, n: int, shortest: float | None, longest: float, w: float) -> np.ndarray:
    """Of the Morlet wavelets at n periods in seconds, in geometric steps, in rows; shortest: two samples by default."""
    return (w + math.sqrt(2 + w * w)) / (4 * math.pi) * periods(n, 2 / sr if shortest is None else shortest, longest) * sr


def morlet(x: np.ndarray, sr: float, n: int, shortest: float | None, longest: float, w: float, rows: int | None = None) -> np.ndarray:
    """Magnitudes (n, len(x)) of the Morlet wavelet transform; rows: of the clip, if x is a part of it."""
    out = np.empty((n, len(x)))
    for k, s in enumerate(widths(sr, n, shortest, longest, w)):
        m = int(min(10 * s, rows or len(x)))
        u = (np.arange(m) - (m - 1) / 2) / s
        wave = np.conj((math.pi**-0.25 * math.sqrt(1 / s) * np.exp(1j * w * u) * np.exp(-0.5 * u * u))[::-1])
        size = 1 << (len(x) + m).bit_length()
        full = np.fft.ifft(np.fft.fft(x, size) * np.fft.fft(wave, size))[: len(x) + m - 1]
        begin = (m - 1) // 2
        out[k] = np.abs(full[begin : begin + len(x)])
    return out


def wavelets(frames: DataFrame, channels: Sequence[str], sr: float, n: int = 25, shortest: float | None = None, longest: float = 100, w: float = 10, normalise: bool = False, every: int = 1, part: int = PART) -> DataFrame:
    """clip_id, t, values: magnitudes of all channels' wavelets, channel after channel, of every `every`-th row, as 32-bit values.

    A wavelet is ten widths long, or as long as its clip, so a row needs the rows within five of the largest width.
    """
    reach = int(5 * widths(sr, n, shortest, longest, w).max()) + 1
    d = z_clip(frames, channels) if normalise else frames
    d = d.select("clip_id", "t", *channels, F.count("*").over(Window.partitionBy("clip_id")).alias("_rows"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        t = pdf["t"].to_numpy()
        begin, end = np.searchsorted(t, (key[1] * part, (key[1] + 1) * part))
        keep = np.arange(begin, end)
        keep = keep[t[keep] % every == 0]
        if not len(keep):
            return pd.DataFrame({"clip_id": pdf["clip_id"].to_numpy()[:0], "t": t[:0], "values": pd.Series([], dtype=object)})
        v = np.concatenate([morlet(pdf[c].to_numpy(float), sr, n, shortest, longest, w, int(pdf["_rows"].iloc[0]))[:, keep] for c in channels]).T.astype(np.float32).astype(float)
        return pd.DataFrame({"clip_id": pdf["clip_id"].to_numpy()[keep], "t": t[keep], "values": list(v)})

    kind = frames.schema["clip_id"].dataType
    return with_parts(d, reach, reach, part).groupBy("clip_id", "_part").applyInPandas(run, StructType([StructField("clip_id", kind), frames.schema["t"], StructField("values", ArrayType(DoubleType()))]))


def mle_dimension(values: np.ndarray, n: int) -> int:
    """How many components Minka's Bayesian choice keeps, from covariance eigenvalues in falling order and n rows."""
    d = len(values)
    v = np.maximum(values, 1e-15)
    best, choice = -math.inf, 1
    for k in range(1, d):
        pu = -k * math.log(2) + sum(math.lgamma((d - i + 1) / 2) - math.log(math.pi) * (d - i + 1) / 2 for i in range(1, k + 1))
        rest = max(v[k:].sum() / (d - k), 1e-15)
        pl, pv = -np.log(v[:k]).sum() * n / 2, -math.log(rest) * n * (d - k) / 2
        m = d * k - k * (k + 1) / 2
        spec = np.concatenate((v[:k], np.full(d - k, rest)))
        pa = sum(math.log(max((v[i] - v[j]) * (1 / spec[j] - 1 / spec[i]), 1e-300)) + math.log(n) for i in range(k) for j in range(i + 1, d))
        score = pu + pl + pv + (m + k) * math.log(2 * math.pi) / 2 - pa / 2 - k * math.log(n) / 2
        if score > best:
            best, choice = score, k
    return choice


class Whitening:
    """Z-scores and principal components of unit variance, fitted by Spark ML on a vector column."""

    def __init__(self, components: int | str = "mle", column: str = "features"):
        self.components, self.column = components, column

    def fit(self, df: DataFrame) -> Whitening:
        from pyspark.ml.feature import StandardScaler
        from pyspark.ml.stat import Correlation

        self.scaler = StandardScaler(withMean=True, withStd=True, inputCol=self.column, outputCol="_z").fit(df)
        n = df.count()
        z = self.scaler.transform(df)
        corr = np.nan_to_num(Correlation.corr(z, "_z").head()[0].toArray())
        value, vector = np.linalg.eigh(corr)
        order = np.argsort(-value)
        value, vector = value[order], vector[:, order]
        k = mle_dimension(value, n) if self.components == "mle" else min(int(self.components), len(value))
        # the scaler divides by the sample deviation; population z-scores are larger by this, their components whitened by the sample variance again
        self.matrix = vector[:, :k] / np.sqrt(np.maximum(value[:k], 1e-12))
        return self

    def transform(self, df: DataFrame, out: str = "white") -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        z = self.scaler.transform(df).withColumn("_a", vector_to_array("_z"))
        cols = [F.aggregate(F.zip_with("_a", F.array(*(F.lit(float(x)) for x in self.matrix[:, j])), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) for j in range(self.matrix.shape[1])]
        return z.withColumn(out, array_to_vector(F.array(*cols))).drop("_z", "_a")
