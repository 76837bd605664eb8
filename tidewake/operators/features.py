"""Features of the rows around each sample, framed by clip.

All statistics of all channels are merged from the same running pieces, so they need one exchange, and windows of any length cost the same.
Frames are cut short at a clip's ends.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewake.functions.expr import azimuth, inclination, norm
from tidewake.functions.lineage import ROWS

from .parts import PART, own, with_parts

TASK = 1 << 18  # rows whose windows one task sorts, about
STATS = ("mean", "std", "skew", "kurt", "max", "min", "autocorr", "trend")


def window_rows(context_sec: float, sr: float) -> int:
    return max(math.ceil(context_sec * sr), 3)


Need = Callable[[WindowSpec, bool], Column]


class Frame:
    """Expressions over the rows t - half .. t + half of a clip, at a cost for each row that doesn't grow with half.

    Time is cut into blocks as long as the frame, so a frame is the rest of one block and the beginning of the next. Both are running
    aggregates, of a block's rows up to each row and from each row on, and a frame merges two of them. Nothing is subtracted: means, central
    moments and comoments are merged by their formulas, so values far from zero lose no digits, and extrema are those of two numbers.

    Expressions are made first; over() then gives a table's rows with what the expressions read. Clips are dealt in parts (parts.py), so a clip
    spans tasks; all windows share that one exchange. Channels hold no nulls.
    """

    def __init__(self, half: int, part: int = PART):
        self.half, self.length, self.part = half, 2 * half + 1, part
        self.needs: dict[str, Need] = {}  # running aggregates
        self.merged: dict[str, Column] = {}  # of two pieces; columns of their own, as several expressions read them
        self.later: dict[str, Column] = {}  # what reads merged ones
        self.paired: set[str] = set()

    def _need(self, name: str, aggregate: Need) -> str:
        self.needs.setdefault(name, aggregate)
        return name

    def _both(self, name: str, alone: Callable[[Column], Column], merged: Callable[[Column, Column], Column], later: bool = False) -> Column:
        """Of the two pieces, merged where both exist."""
        a, b, name = F.col("_rest"), F.col("_begun"), f"_w_{name}"
        (self.later if later else self.merged).setdefault(name, F.when(a.isNull(), alone(b)).when(b.isNull(), alone(a)).otherwise(merged(a, b)))
        return F.col(name)

    def _sum(self, name: str, aggregate: Need) -> Column:
        self._need(name, aggregate)
        return self._both(name, lambda a: a[name], lambda a, b: a[name] + b[name])

    def total(self, c: Column, name: str) -> Column:
        return self._sum(f"sum_{name}", lambda w, up: F.sum(c).over(w))

    def count(self) -> Column:
        return self._sum("n", lambda w, up: F.count("*").over(w))

    def extreme(self, c: str, kind: str) -> Column:
        name = self._need(f"{kind}_{c}", lambda w, up: getattr(F, kind)(F.col(c)).over(w))
        pick = F.greatest if kind == "max" else F.least
        return self._both(name, lambda a: a[name], lambda a, b: pick(a[name], b[name]))

    def _mean(self, c: str) -> str:
        self.count()
        return self._need(f"mean_{c}", lambda w, up: F.avg(F.col(c).cast("double")).over(w))

    def mean(self, c: str) -> Column:
        m = self._mean(c)
        return self._both(m, lambda a: a[m], lambda a, b: a[m] + (b[m] - a[m]) * b["n"] / (a["n"] + b["n"]))

    def central(self, c: str, power: int = 2) -> Column:
        """Sum of the powers (2 to 4) of differences from the mean."""
        m, x = self._mean(c), F.col(c).cast("double")
        m2 = self._need(f"m2_{c}", lambda w, up: F.var_pop(x).over(w) * F.count("*").over(w))
        m3, m4 = f"m3_{c}", f"m4_{c}"
        if power > 2:
            self._need(m3, lambda w, up: F.when(F.var_pop(x).over(w) > 0, F.skewness(x).over(w) * F.count("*").over(w) * F.pow(F.var_pop(x).over(w), 1.5)).otherwise(0.0))
        if power > 3:
            self.central(c, 3)
            self._need(m4, lambda w, up: F.when(F.var_pop(x).over(w) > 0, (F.kurtosis(x).over(w) + 3) * F.count("*").over(w) * F.var_pop(x).over(w) * F.var_pop(x).over(w)).otherwise(0.0))

        def merged(a: Column, b: Column) -> Column:
            p, q, d = a["n"].cast("double"), b["n"].cast("double"), b[m] - a[m]
            s = p + q
            if power == 2:
                return a[m2] + b[m2] + d * d * p * q / s
            if power == 3:
                return a[m3] + b[m3] + d * d * d * p * q * (p - q) / (s * s) + 3 * d * (p * b[m2] - q * a[m2]) / s
            far = d * d * d * d * p * q * (p * p - p * q + q * q) / (s * s * s)
            return a[m4] + b[m4] + far + 6 * d * d * (p * p * b[m2] + q * q * a[m2]) / (s * s) + 4 * d * (p * b[m3] - q * a[m3]) / s

        return self._both(f"m{power}_{c}", lambda a: a[f"m{power}_{c}"], merged)

    def comoment(self, x: str, y: str) -> Column:
        """Sum of the products of both channels' differences from their means."""
        mx, my = self._mean(x), self._mean(y)
        c = self._need(f"c_{x}_{y}", lambda w, up: F.covar_pop(F.col(x).cast("double"), F.col(y).cast("double")).over(w) * F.count("*").over(w))
        return self._both(c, lambda a: a[c], lambda a, b: a[c] + b[c] + (b[mx] - a[mx]) * (b[my] - a[my]) * a["n"] * b["n"] / (a["n"] + b["n"]))

    def lagged(self, x: str) -> tuple[Column, Column]:
        """Pairs of neighbouring rows of the frame: how many, and the sum of the products of their differences from the frame's mean.

        A piece knows the pairs inside it; where two are merged, the last row of the one and the first of the other are one more pair.
        """
        self.paired.add(x)
        own = F.col(x).cast("double")
        late, early = (lambda up: own if up else F.col(f"_lead_{x}")), (lambda up: F.col(f"_lag_{x}") if up else own)
        n, ml, me, c = f"pn_{x}", f"pl_{x}", f"pe_{x}", f"pc_{x}"
        known = lambda up: F.col(f"_lag_{x}" if up else f"_lead_{x}").isNotNull()
        self._need(n, lambda w, up: F.count(F.when(known(up), 1)).over(w))
        self._need(ml, lambda w, up: F.coalesce(F.avg(F.when(known(up), late(up))).over(w), F.lit(0.0)))
        self._need(me, lambda w, up: F.coalesce(F.avg(F.when(known(up), early(up))).over(w), F.lit(0.0)))
        self._need(c, lambda w, up: F.coalesce(F.covar_pop(late(up), early(up)).over(w), F.lit(0.0)) * F.count(F.when(known(up), 1)).over(w))
        edge = self._need(f"edge_{x}", lambda w, up: F.first(own).over(w))  # a rest's last row, a begin's first one
        mean = self.mean(x)
        about = lambda p: p[c] + p[n] * (p[ml] - mean) * (p[me] - mean)
        pairs = self._both(n, lambda a: a[n], lambda a, b: a[n] + b[n] + 1)
        return pairs, self._both(f"lagged_{x}", about, lambda a, b: about(a) + about(b) + (b[edge] - mean) * (a[edge] - mean), later=True)

    def stats(self, x: str, wanted: Sequence[str] = STATS) -> dict[str, Column]:
        """Statistics of channel x, all eight or the wanted ones."""
        n, m2 = self.count(), self.central(x)
        sd, var = F.when(n > 1, F.sqrt(m2 / (n - 1))), m2 / n
        flat = F.coalesce(sd, F.lit(0.0)) == 0

        def autocorr() -> Column:
            pairs, both = self.lagged(x)
            return F.when(pairs == 0, 0.0).otherwise(both / F.nullif(pairs, F.lit(0)) / (sd * sd + 1e-12))

        made: dict[str, Callable[[], Column]] = {
            "mean": lambda: self.mean(x),
            "std": lambda: sd,
            "skew": lambda: F.when(flat, 0.0).otherwise(self.central(x, 3) / n / F.pow(var, 1.5) * F.pow((n - 1) / n, 1.5)),
            "kurt": lambda: F.when(flat, -3.0).otherwise(self.central(x, 4) / n / (var * var) * F.pow((n - 1) / n, 2.0) - 3),
            "max": lambda: self.extreme(x, "max"),
            "min": lambda: self.extreme(x, "min"),
            "autocorr": autocorr,
            "trend": lambda: self.comoment(x, "t"),
        }
        return {s: made[s]() for s in wanted}

    def corr(self, a: str, b: str) -> Column:
        return self.comoment(a, b) / (F.sqrt(self.central(a) * self.central(b)) + 1e-12)

    def circular_variance(self, angle: Column, name: str) -> Column:
        c, s = self.total(F.cos(angle), f"cos_{name}"), self.total(F.sin(angle), f"sin_{name}")
        return 1 - F.sqrt(c * c + s * s) / self.count()

    def dynamic(self, axes: Sequence[str], name: str = "dynamic") -> Column:
        return self.total(sum((F.abs(F.col(a)) for a in axes), F.lit(0.0)), name) / self.count()

    @staticmethod
    def _tasks(frames: DataFrame) -> int:
        """One for TASK rows, or all cores. A row is sorted with its pieces, many times wider than what was shuffled, so the number follows the rows, not bytes or the session's settings."""
        n = frames.count()
        return max(2, -(-n // TASK), min(frames.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS)))

    def over(self, frames: DataFrame) -> DataFrame:
        """The rows of frames (one for each clip_id and t) with the two pieces that the expressions made so far read."""
        d = with_parts(frames, self.half, self.half, self.part).repartition(self._tasks(frames), "clip_id", "_part").withColumn("_block", F.floor(F.col("t") / self.length))
        clip = Window.partitionBy("clip_id", "_part")
        block = Window.partitionBy("clip_id", "_part", "_block")
        if self.paired:
            d = d.withColumns({f"_{k}_{x}": f(F.col(x).cast("double")).over(block.orderBy("t")) for x in sorted(self.paired) for k, f in (("lag", F.lag), ("lead", F.lead))})
        so_far = lambda o: block.orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        for name, order, up in (("_up", F.col("t"), True), ("_down", F.desc("t"), False)):
            d = d.withColumns({f"{name}_{k}": e(so_far(order), up) for k, (_, e) in enumerate(self.needs.items())})
            d = d.withColumn(name, F.struct(*(F.col(f"{name}_{k}").alias(n) for k, n in enumerate(self.needs)))).drop(*(f"{name}_{k}" for k in range(len(self.needs))))
        begun = F.struct("t", "_block", "_up")
        end = F.max_by(begun, "t").over(clip)  # where the clip ends before the frame does
        d = d.withColumns({"_rest": F.lag("_down", self.half).over(clip.orderBy("t")), "_begun": F.coalesce(F.lead(begun, self.half).over(clip.orderBy("t")), end)}).where(own(self.part))
        inside = F.col("_rest").isNotNull() & (F.col("_begun._block") == F.floor((F.col("t") - self.half) / self.length))
        d = d.withColumn("_begun", F.when(~inside, F.col("_begun._up"))).drop("_up", "_down")
        return d.withColumns(self.merged).withColumns(self.later) if self.later else d.withColumns(self.merged)


def channel_features(frames: DataFrame, channels: Sequence[str], half: int, stats: Sequence[str] = STATS) -> DataFrame:
    """clip_id, t and <channel>_<statistic>."""
    f = Frame(half)
    wanted = {c: f.stats(c, stats) for c in channels}
    return f.over(frames).select("clip_id", "t", *(wanted[c][s].alias(f"{c}_{s}") for s in stats for c in channels))


def triads(channels: Sequence[str]) -> list[list[str]]:
    return [list(channels[k : k + 3]) for k in range(0, len(channels) // 3 * 3, 3)]


def feature_set(frames: DataFrame, channels: Sequence[str], half: int, static: Mapping[str, str] | None = None, dynamic: Mapping[str, str] | None = None, dynamic_only: bool = False) -> DataFrame:
    """clip_id, t and the whole feature vector in its fixed order; other columns of frames stay.

    Per accelerometer triad: eight statistics of x, y, z and their norm, three correlations, circular variances of inclination and azimuth; then
    mean dynamic acceleration; then statistics of the other channels; then correlations of gyroscope triads. static, dynamic: the
    columns of each channel's parts, of which raw is the sum; with dynamic_only the channels are dynamic already.
    """
    acc = [c for c in channels if "Acc" in c]
    other, gyro = [c for c in channels if "Acc" not in c], [c for c in channels if "Gyr" in c]
    if not acc or len(acc) % 3:
        raise ValueError("accelerometer channels must come in threes")
    if not dynamic_only and not dynamic:
        raise ValueError("the feature set needs a static and a dynamic part")
    d, f, out = frames, Frame(half), {}
    if static and dynamic:
        d = d.withColumns({a: F.col(static[a]) + F.col(dynamic[a]) for a in acc})
    groups = triads(acc)
    for k, axes in enumerate(groups):
        d = d.withColumn(f"_q{k}", norm(*axes))
    for k, axes in enumerate(groups):
        q = F.col(f"_q{k}")
        all4 = {c: f.stats(c) for c in [*axes, f"_q{k}"]}
        out |= {f"a{k}_{s}_{j}": all4[c][s] for s in STATS for j, c in enumerate(all4)}
        out |= {f"a{k}_corr_{j}": f.corr(a, b) for j, (a, b) in enumerate(((axes[0], axes[1]), (axes[0], axes[2]), (axes[1], axes[2])))}
        out |= {f"a{k}_inclination": f.circular_variance(inclination(F.col(axes[2]), q), f"inclination{k}"), f"a{k}_azimuth": f.circular_variance(azimuth(F.col(axes[1]), F.col(axes[2])), f"azimuth{k}")}
    for k, axes in enumerate(groups):
        out[f"a{k}_dynamic"] = f.dynamic([dynamic[a] if dynamic else a for a in axes], f"dynamic{k}")
    for c in other:
        out |= {f"{c}_{s}": e for s, e in f.stats(c).items()}
    for k, axes in enumerate(triads(gyro)):
        out |= {f"g{k}_corr_{j}": f.corr(a, b) for j, (a, b) in enumerate(((axes[0], axes[1]), (axes[0], axes[2]), (axes[1], axes[2])))}
    keys = [c for c in frames.columns if c in ("clip_id", "t", "individual_id", "label")]
    return f.over(d).select(*keys, *(e.alias(n) for n, e in out.items()))
