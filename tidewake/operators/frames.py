"""Samples of recordings as rows: their time, splits, subsets and weights.

frames: clip_id, t (place in the clip), individual_id, label, channels ..., one row a sample. Nothing here needs a clip in one task: windows
by clip are framed or counted, and what must be numbered over all clips uses a table of counts by clip.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions.expr import path_key


def with_time(df: DataFrame, clip: str, order: Sequence[str]) -> DataFrame:
    """t: place of each row in its clip by a total order, from 0."""
    return df.withColumn("t", (F.row_number().over(Window.partitionBy(clip).orderBy(*order)) - 1).cast("long"))


def project(frames: DataFrame, schema: Sequence[str], wanted: Sequence[str]) -> DataFrame:
    """The wanted channels in the schema's order, after the key columns."""
    keys = [c for c in ("clip_id", "t", "individual_id", "label") if c in frames.columns]
    return frames.select(*keys, *(c for c in schema if c in set(wanted)))


def annotated(frames: DataFrame, unknown: int = 0) -> DataFrame:
    return frames.where(F.col("label") != unknown)


def assign_split(frames: DataFrame, clips: DataFrame, folds: dict[str, list[int]]) -> DataFrame:
    """split of each row by its clip's fold; test is looked up first, then val, then train. clips: clip_id, fold (a row a clip).

    A row whose clip is unknown, or in none of the folds, ends the job with an error; use checked() to see all such clips first.
    """
    f = F.col("fold")
    named = F.when(f.isin(folds["test"] or [-1]), "test").when(f.isin(folds["val"] or [-1]), "val").when(f.isin(folds["train"] or [-1]), "train")
    joined = frames.join(clips.select("clip_id", named.alias("split")), "clip_id", "left")
    missing = F.raise_error(F.concat(F.lit("clip without a split: "), F.coalesce(F.col("clip_id").cast("string"), F.lit("null"))))
    return joined.withColumn("split", F.coalesce("split", missing))


def unmatched_clips(frames: DataFrame, clips: DataFrame) -> DataFrame:
    """Clips with samples but no metadata, and the other way round; empty if the dataset is complete."""
    seen = frames.select("clip_id").distinct()
    return seen.join(clips, "clip_id", "left_anti").select("clip_id", F.lit("no metadata").alias("fault")).unionByName(clips.select("clip_id").join(seen, "clip_id", "left_anti").select("clip_id", F.lit("no samples").alias("fault")))


def checked(frames: DataFrame, clips: DataFrame) -> DataFrame:
    if bad := unmatched_clips(frames, clips).take(5):
        raise ValueError(f"clips and metadata differ: {[tuple(r) for r in bad]}")
    return frames


def every_nth(frames: DataFrame, n: int) -> DataFrame:
    """Rows 0, n, 2n, ... of each clip."""
    return frames.where(F.col("t") % n == 0)


def numbered(rows: DataFrame) -> DataFrame:
    """index: place of each row over all clips, in the order of clip files and t. A clip's rows are numbered in it, clips by their counts."""
    counts = rows.groupBy("clip_id").agg(F.count("*").alias("_n"))  # a row a clip
    offset = counts.select("clip_id", (F.sum("_n").over(Window.orderBy(path_key())) - F.col("_n")).alias("_from"))
    own = F.row_number().over(Window.partitionBy("clip_id").orderBy("t")) - 1
    return rows.withColumn("_own", own).join(offset, "clip_id").withColumn("index", F.col("_from") + F.col("_own")).drop("_from", "_own")


def upsampled(frames: DataFrame, strided: DataFrame, n: int) -> DataFrame:
    """clip_id, t, pred for every row of frames from predictions for rows 0, n, 2n, ... of each clip.

    The places of the m predictions are stretched over the clip's rows, and a row takes the one it falls on: floor((t + 1/2) m / rows).
    """
    rows = frames.groupBy("clip_id").agg(F.count("*").alias("_n"))
    m = strided.groupBy("clip_id").agg(F.count("*").alias("_m"))
    at = F.floor((2 * F.col("t") + 1) * F.col("_m") / (2 * F.col("_n"))).alias("_k")
    wanted = frames.select("clip_id", "t").join(rows, "clip_id").join(m, "clip_id").select("clip_id", "t", at)
    return wanted.join(strided.select("clip_id", (F.col("t") / n).cast("long").alias("_k"), "pred"), ["clip_id", "_k"]).select("clip_id", "t", "pred")


def raster_frame(points: DataFrame, size: int, border: int, x: str = "x", y: str = "y") -> DataFrame:
    """One row: the least value of either axis (_x, _y), and the cells a unit (_s; null without points, or with equal ones only)."""
    low = points.agg(F.min(x).alias("_x"), F.min(y).alias("_y"), F.max(x).alias("_u"), F.max(y).alias("_v"))
    return low.select("_x", "_y", ((size - 2 * border) / F.nullif(F.greatest(F.col("_u") - F.col("_x"), F.col("_v") - F.col("_y")), F.lit(0.0))).alias("_s"))


def raster_cells(points: DataFrame, fitted: DataFrame, size: int, border: int, x: str = "x", y: str = "y") -> DataFrame:
    """points with their cell (row, col) in the raster of fitted, of raster_frame(); points beyond its edge take the cell at the edge."""
    cell = lambda c, first: F.least(F.greatest(((F.col(c) - F.col(first)) * F.coalesce("_s", F.lit(0.0))).cast("long") + border, F.lit(0)), F.lit(size - 1))
    return points.crossJoin(F.broadcast(fitted)).withColumns({"row": cell(x, "_x"), "col": cell(y, "_y")}).drop("_x", "_y", "_s")


def raster(points: DataFrame, size: int, border: int, x: str = "x", y: str = "y") -> DataFrame:
    """row, col, n, density: points counted on a raster of size x size cells, filled to a border; density is n over the fullest cell's.

    Both axes begin at their least value and share one scale. Without points, or with equal ones only, there is one cell or none.
    """
    cells = raster_cells(points.select(x, y), raster_frame(points, size, border, x, y), size, border, x, y).groupBy("row", "col").agg(F.count("*").alias("n"))
    top = cells.agg(F.max("n").alias("_top"))
    return cells.crossJoin(F.broadcast(top)).select("row", "col", "n", (F.col("n") / F.col("_top")).alias("density"))


def peaks(cells: DataFrame, value: str = "n") -> DataFrame:
    """row, col and value of the cells that none of their eight neighbours exceeds (equal neighbours are all peaks); cells that are not there, or not
    above 0, are no peaks. Each cell is told to its neighbours, and a cell's messages are aggregated partly before the one shuffle."""
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    told = cells.select("row", "col", F.col(value).alias("_v"), F.explode(steps).alias("_d"))
    own = F.when((F.col("_d.i") == 0) & (F.col("_d.j") == 0), F.col("_v"))
    met = told.groupBy((F.col("row") + F.col("_d.i")).alias("row"), (F.col("col") + F.col("_d.j")).alias("col")).agg(F.max(own).alias(value), F.max("_v").alias("_top"))
    return met.where((F.col(value) > 0) & (F.col(value) == F.col("_top"))).drop("_top")


def segments(frames: DataFrame, picks: int = 3, length: int = 20_000, seed: int = 607) -> DataFrame:
    """pick, clip_id, start, end: clips picked at random, with replacement, and a random segment of each; a clip no longer than `length` is taken whole.

    A pick keeps its clip over reruns: it is the clip whose hash with the pick's number is least.
    """
    n = frames.groupBy("clip_id").agg(F.count("*").alias("_n"))
    best = lambda k: F.min(F.struct(F.xxhash64(F.lit(seed), F.lit(k), "clip_id").alias("h"), "clip_id", "_n"))
    row = n.agg(F.array(*(best(k) for k in range(picks))).alias("p")).select(F.posexplode("p").alias("pick", "x")).where("x IS NOT NULL")
    start = F.when(F.col("x._n") <= length, F.lit(0)).otherwise(F.pmod(F.xxhash64(F.lit(seed + 1), "pick", "x.clip_id"), F.col("x._n") - length))
    return row.select("pick", "x.clip_id", start.cast("long").alias("start"), F.least(start + length, "x._n").cast("long").alias("end"))


def every_nth_overall(rows: DataFrame, n: int) -> DataFrame:
    """Every n-th row of all clips stacked; the phase goes on over clips."""
    return numbered(rows).where(F.col("index") % n == 0)


def every_nth_annotated(frames: DataFrame, n: int, unknown: int = 0) -> DataFrame:
    return every_nth_overall(annotated(frames, unknown), n)


def whole_windows(frames: DataFrame, w: int) -> DataFrame:
    """Without the last rows of a clip that fill no window of w."""
    n = F.count("*").over(Window.partitionBy("clip_id"))
    return frames.withColumn("_n", n).where("t < _n - _n % {}".format(int(w))).drop("_n")


def window_starts(frames: DataFrame, w: int) -> DataFrame:
    """First rows of sliding windows of w rows: 0 .. n - w - 1 of each clip."""
    n = F.count("*").over(Window.partitionBy("clip_id"))
    return frames.withColumn("_n", n).where(F.col("t") < F.col("_n") - w).drop("_n")


def annotated_starts(frames: DataFrame, w: int, unknown: int = 0) -> DataFrame:
    """Starts of windows that hold an annotated row."""
    ahead = Window.partitionBy("clip_id").orderBy("t").rowsBetween(0, w - 1)
    known = F.max((F.col("label") != unknown).cast("int")).over(ahead)
    n = F.count("*").over(Window.partitionBy("clip_id"))
    return frames.withColumns({"_known": known, "_n": n}).where((F.col("_known") == 1) & (F.col("t") < F.col("_n") - w)).drop("_known", "_n")


def sliding_windows(frames: DataFrame, w: int, channel: str) -> DataFrame:
    """clip_id, t, values: the rows of each sliding window."""
    ahead = Window.partitionBy("clip_id").orderBy("t").rowsBetween(0, w - 1)
    return window_starts(frames.withColumn("values", F.collect_list(channel).over(ahead)), w).select("clip_id", "t", "values")


def tumbling(frames: DataFrame, w: int, channels: Sequence[str], pad: bool = True) -> DataFrame:
    """clip_id, chunk, n and an array of each channel in chunks of w rows; a short last one is filled with the channel's mean if pad."""
    g = frames.groupBy("clip_id", F.floor(F.col("t") / w).alias("chunk"))
    arrays = [F.transform(F.array_sort(F.collect_list(F.struct("t", F.col(c).alias("v")))), lambda x: x["v"]).alias(c) for c in channels]
    out = g.agg(F.count("*").alias("n"), *arrays, *(F.avg(c).alias(f"_{c}") for c in channels))
    for c in channels if pad else ():
        out = out.withColumn(c, F.concat(F.col(c), F.array_repeat(F.col(f"_{c}"), (F.lit(w) - F.col("n")).cast("int"))))
    return out.drop(*(f"_{c}" for c in channels))


def trailing_windows(frames: DataFrame, w: int, channel: str) -> DataFrame:
    """clip_id, t, values: w rows up to each row; before the clip's begin it is mirrored."""
    own = Window.partitionBy("clip_id").orderBy("t")
    back, ahead = F.collect_list(channel).over(own.rowsBetween(-(w - 1), 0)), F.collect_list(channel).over(own.rowsBetween(0, w - 1))
    d = frames.withColumns({"_b": back, "_a": ahead})
    # places -1, -2, ... are places 1, 2, ...; rows 0 .. w-1 hold all that is needed
    head = F.first("_a").over(own.rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_h", head)
    lack = (F.lit(w) - F.size("_b")).cast("int")
    mirror = F.when(lack > 0, F.reverse(F.slice("_h", 2, F.greatest(lack, F.lit(0))))).otherwise(F.slice("_h", 1, 0))
    return d.select("clip_id", "t", F.concat(mirror, "_b").alias("values"))


def centred_windows(frames: DataFrame, half: int, channel: str) -> DataFrame:
    """clip_id, t, values: rows t - half .. t + half - 1 of each row's clip, mirrored at the clip's ends.

    What a clip is too short to mirror is left out of its windows.
    """
    own = Window.partitionBy("clip_id").orderBy("t")
    d = frames.withColumns({"_w": F.collect_list(channel).over(own.rowsBetween(-half, half)), "_n": F.count("*").over(Window.partitionBy("clip_id"))})
    before, after = F.greatest(F.lit(half) - F.col("t"), F.lit(0)), F.greatest(F.col("t") + half - F.col("_n"), F.lit(0))
    inside = F.least(F.col("t") + half, F.col("_n")) - F.greatest(F.col("t") - half, F.lit(0))
    cut = lambda a, at, n: F.slice(a, F.lit(at), n.cast("int"))
    return d.select("clip_id", "t", F.concat(F.reverse(cut("_w", 2, before)), cut("_w", 1, inside), cut(F.reverse("_w"), 2, after)).alias("values"))


def rescaled_windows(frames: DataFrame, w: int, channel: str, share: float, shift: Column | None = None, seed: int = 0) -> DataFrame:
    """clip_id, t, values: sliding windows that begin at t and are stretched or shrunk in time to w rows.

    A window spans w + shift rows, or what its clip still has, and takes the rows that w even steps through it fall on. shift: a random whole number in
    [-share * w, share * w) that reruns keep, or a column. With share 0 (or under 1 / w) windows are as they stand.
    """
    most = int(share * w)
    if not 0 <= share < 1:
        raise ValueError("share must be at least 0 and below 1")
    if shift is None:
        shift = F.pmod(F.xxhash64(F.lit(seed), "clip_id", "t"), F.lit(max(1, 2 * most))) - most
    ahead = Window.partitionBy("clip_id").orderBy("t").rowsBetween(0, w + most - 1)
    d = window_starts(frames.withColumns({"_a": F.collect_list(channel).over(ahead), "_s": shift.cast("int")}), w)
    span = F.least(F.size("_a"), F.lit(w) + F.col("_s"))
    at = lambda k: F.floor(k * span / w).cast("int")
    return d.select("clip_id", "t", F.transform(F.sequence(F.lit(0), F.lit(w - 1)), lambda k: F.get("_a", at(k))).alias("values"))


def label_grid(frames: DataFrame, known: Sequence[int]) -> DataFrame:
    """individual_id, label, n for every individual and known label, absent ones with 0."""
    spark = frames.sparkSession
    labels = spark.createDataFrame([(k,) for k in known], "label int")
    people = frames.select("individual_id").distinct()
    counts = frames.groupBy("individual_id", "label").agg(F.count("*").alias("n"))
    return people.crossJoin(F.broadcast(labels)).join(counts, ["individual_id", "label"], "left").fillna(0, ["n"])  # labels: a short list


def _ranked(frames: DataFrame, known: Sequence[int], key: Column) -> DataFrame:
    least = label_grid(frames, known).groupBy("individual_id").agg(F.min("n").alias("_least"))
    rank = F.row_number().over(Window.partitionBy("individual_id", "label").orderBy(key, "clip_id", "t"))
    return frames.where(F.col("label").isin(list(known))).withColumn("_rank", rank).join(least, "individual_id")


def sampling_key(seed: int = 0) -> Column:
    """A random order that reruns and other partitions keep."""
    return F.xxhash64(F.lit(seed), "clip_id", "t")


def balanced(frames: DataFrame, known: Sequence[int], key: Column | None = None) -> DataFrame:
    """Of each individual as many rows of every known class as of its smallest one; none if a class is absent."""
    return _ranked(frames, known, sampling_key() if key is None else key).where("_rank <= _least").drop("_rank", "_least")


def balanced_mask(frames: DataFrame, known: Sequence[int], unknown: int = 0, key: Column | None = None) -> DataFrame:
    """All rows; those that balanced() would drop are unknown."""
    kept = balanced(frames, known, key).select("clip_id", "t", F.lit(1).alias("_kept"))
    return frames.join(kept, ["clip_id", "t"], "left").withColumn("label", F.when(F.col("_kept") == 1, F.col("label")).otherwise(F.lit(unknown))).drop("_kept")


def class_proportions(frames: DataFrame, unknown: int = 0) -> DataFrame:
    """label, n, proportion: each label's rows over all annotated rows; the unknown label has an entry too."""
    counts = frames.groupBy("label").agg(F.count("*").alias("n"))
    known = F.sum(F.when(F.col("label") != unknown, F.col("n")).otherwise(0)).over(Window.partitionBy())  # over a row a label
    return counts.withColumn("proportion", F.col("n") / F.nullif(known, F.lit(0)))


def class_weights(frames: DataFrame, unknown: int = 0) -> DataFrame:
    """label, inverse_weight, balanced_weight of known labels."""
    p = class_proportions(frames, unknown).where(F.col("label") != unknown)
    every = Window.partitionBy()
    balanced_ = F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))
    return p.select("label", (1 / (F.col("proportion") + F.lit(1e-6))).alias("inverse_weight"), balanced_.alias("balanced_weight"))
