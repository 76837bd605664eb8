"""Scores of predictions: cluster maps, confusion, precision, recall, F1, homogeneity, bouts; for any grouping keys.

frames: clip_id, t, individual_id, label, pred. Everything counts first, by (keys, label, pred), and works on these counts: one shuffle of
partly aggregated rows, whatever the number of scores.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions.expr import path_key, ratio, shift_unknown


def contingency(frames: DataFrame, keys: Sequence[str] = (), unknown: int = 0) -> DataFrame:
    """keys, pred, label, n over annotated rows."""
    return frames.where(F.col("label") != unknown).groupBy(*keys, "pred", "label").agg(F.count("*").alias("n"))


def cluster_map(counts: DataFrame, clusters: int, keys: Sequence[str] = (), unknown: int = 0) -> DataFrame:
    """keys, pred, label: each cluster's most frequent label; of equals the smallest; clusters without annotated rows are unknown."""
    top = counts.groupBy(*keys, "pred").agg(F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("_top"))
    top = top.select(*keys, "pred", (-F.col("_top.l")).alias("label"))
    every = counts.sparkSession.range(clusters).select(F.col("id").cast("int").alias("pred"))
    if keys:
        every = counts.select(*keys).distinct().crossJoin(F.broadcast(every))  # as many rows as clusters
    return every.join(top, [*keys, "pred"], "left").select(*keys, "pred", F.coalesce("label", F.lit(unknown)).cast("int").alias("label"))


def apply_map(frames: DataFrame, mapping: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """frames with pred replaced by its label. Fails on a cluster that the map lacks."""
    m = mapping.select(*keys, F.col("pred"), F.col("label").alias("_mapped"))
    out = frames.join(m, [*keys, "pred"], "left")
    return out.withColumn("pred", F.coalesce("_mapped", F.raise_error(F.lit("a prediction has no entry in the cluster map")).cast("int"))).drop("_mapped")


def supervised(frames: DataFrame) -> DataFrame:
    return frames.withColumn("pred", shift_unknown(F.col("pred")))


def _labels(df: DataFrame, known: Sequence[int], name: str) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame([(k,) for k in known], f"{name} int"))  # a short list


def confusion(counts: DataFrame, known: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """keys, label, pred, n on the whole grid of known labels. Rows predicted as unknown are not in it."""
    own = counts.groupBy(*keys, "label", "pred").agg(F.sum("n").alias("n"))
    grid = _labels(counts, known, "label").crossJoin(_labels(counts, known, "pred"))
    if keys:
        grid = counts.select(*keys).distinct().crossJoin(grid)
    return grid.join(own, [*keys, "label", "pred"], "left").fillna(0, ["n"])


def label_scores(counts: DataFrame, known: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """keys, label, tp, fp, fn, precision, recall, f1 of every known label; an empty denominator gives 1."""
    side = F.explode(F.array(F.struct(F.col("label").alias("l"), F.lit(True).alias("own")), F.struct(F.col("pred").alias("l"), F.lit(False).alias("own"))))
    c = counts.select(*keys, "n", (F.col("label") == F.col("pred")).alias("hit"), side.alias("s"))
    c = c.groupBy(*keys, F.col("s.l").cast("int").alias("label")).agg(
        F.sum(F.when(F.col("hit") & F.col("s.own"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("hit") & ~F.col("s.own"), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~F.col("hit") & F.col("s.own"), F.col("n")).otherwise(0)).alias("fn"),
    )
    grid = _labels(counts, known, "label")
    if keys:
        grid = counts.select(*keys).distinct().crossJoin(grid)
    c = grid.join(c, [*keys, "label"], "left").fillna(0, ["tp", "fp", "fn"])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(*keys, "label", "tp", "fp", "fn", ratio(tp, tp + fp, 1).alias("precision"), ratio(tp, tp + fn, 1).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn, 1).alias("f1"))


def macro_scores(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, macro_precision, macro_recall, macro_f1: plain means over all known labels, absent ones included."""
    return scores.groupBy(*keys).agg(*(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))


def label_counts(counts: DataFrame, known: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """keys, label, truth, predicted: annotated rows by their label, and by their prediction."""
    s = label_scores(counts, known, keys)
    return s.select(*keys, "label", (F.col("tp") + F.col("fn")).alias("truth"), (F.col("tp") + F.col("fp")).alias("predicted"))


def homogeneity(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, homogeneity: 1 - H(label | cluster) / H(label); 1 where only one label occurs. counts: of raw predictions."""
    by = lambda *c: Window.partitionBy(*keys, *c)
    n = F.col("n")
    c = counts.groupBy(*keys, "pred", "label").agg(F.sum("n").alias("n"))
    c = c.withColumns({"_all": F.sum(n).over(by()), "_k": F.sum(n).over(by("pred")), "_c": F.sum(n).over(by("label"))})
    # each cell's share of H(C): -n/N ln(n_c/N) sums to it over clusters
    h = c.groupBy(*keys).agg(F.sum(-n / F.col("_all") * F.ln(n / F.col("_k"))).alias("_hck"), F.sum(-n / F.col("_all") * F.ln(F.col("_c") / F.col("_all"))).alias("_hc"))
    small = F.col("_hc") < 1e-14
    return h.select(*keys, F.when(small, 1.0).otherwise(1 - F.col("_hck") / F.when(small, 1.0).otherwise(F.col("_hc"))).alias("homogeneity"))


def bouts(frames: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, rows, bouts: runs of equal predictions over each group's clips one after another, in the order of their files.

    Changes are counted in each clip; where clips meet, the ends of neighbours are compared in a table of a row a clip, so even a
    group of all clips is never one task's window over samples.
    """
    own = Window.partitionBy(*keys, "clip_id").orderBy("t")
    d = frames.select(*keys, "clip_id", "t", "pred", F.lag("pred").over(own).alias("_last"))
    ends = d.groupBy(*keys, "clip_id").agg(F.count("*").alias("rows"), F.sum(F.when(F.col("pred") != F.col("_last"), 1).otherwise(0)).alias("_changes"), F.min_by("pred", "t").alias("_first"), F.max_by("pred", "t").alias("_end"))
    before = F.lag("_end").over(Window.partitionBy(*keys).orderBy(path_key()))
    ends = ends.withColumn("_met", F.when(F.col("_first") != before, 1).otherwise(0))
    return ends.groupBy(*keys).agg(F.sum("rows").alias("rows"), (1 + F.sum("_changes") + F.sum("_met")).alias("bouts"))


def time_scale_ratio(frames: DataFrame, sr: float, target: DataFrame | float, keys: Sequence[str] = ()) -> DataFrame:
    """keys, time_scale_ratio: the mean bout's seconds over the target's. target: seconds, or a table (keys, mean_dur_sec)."""
    b = bouts(frames, keys)
    if isinstance(target, DataFrame):
        b, goal = b.join(target, list(keys)), F.col("mean_dur_sec")
    else:
        goal = F.lit(float(target))
    return b.select(*keys, (F.col("rows") / F.col("bouts") / F.lit(float(sr)) / goal).alias("time_scale_ratio"))


def scored(frames: DataFrame, known: Sequence[int], keys: Sequence[str] = (), unknown: int = 0, sr: float = 1.0, target: DataFrame | float = 1.0) -> DataFrame:
    """A row a group: macro scores and time scale ratio of mapped or shifted predictions. Groups without annotated rows have null scores and annotated false."""
    counts = contingency(frames, keys, unknown)
    macro = macro_scores(label_scores(counts, known, keys), keys)
    ratio_ = time_scale_ratio(frames, sr, target, keys)
    if not keys:
        return ratio_.crossJoin(macro).withColumn("annotated", F.lit(True))
    return ratio_.join(macro, list(keys), "left").withColumn("annotated", F.col("macro_f1").isNotNull())


def individualised(frames: DataFrame, known: Sequence[int], clusters: int, unknown: int = 0) -> DataFrame:
    """individual_id and macro scores where each individual has a cluster map of its own."""
    keys = ["individual_id"]
    m = cluster_map(contingency(frames, keys, unknown), clusters, keys, unknown)
    return macro_scores(label_scores(contingency(apply_map(frames, m, keys), keys, unknown), known, keys), keys)


def f1_consistency(frames: DataFrame, known: Sequence[int], clusters: int, unknown: int = 0) -> DataFrame:
    """label, mean_f1_individualised: mean over individuals of F1 under each one's own map."""
    keys = ["individual_id"]
    m = cluster_map(contingency(frames, keys, unknown), clusters, keys, unknown)
    return label_scores(contingency(apply_map(frames, m, keys), keys, unknown), known, keys).groupBy("label").agg(F.avg("f1").alias("mean_f1_individualised"))


def masked_accuracy(frames: DataFrame, known: Sequence[int], unknown: int = 0) -> DataFrame:
    """Mean over known labels that occur of their recall; annotated rows only."""
    s = label_scores(contingency(frames, (), unknown), known)
    return s.where("tp + fn > 0").agg(F.avg("recall").alias("accuracy"))


def evaluate(frames: DataFrame, known: Sequence[int], clusters: int | None = None, unknown: int = 0, sr: float = 1.0, overall_target: float = 1.0, targets: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of an evaluation of frames that also have `split`. With clusters (unsupervised), the map is learnt on train, or on the split itself if train is empty.

    overall: split, homogeneity, macro scores, time_scale_ratio; individual: the same by individual; labels: scores and counts by split and
    label; confusion; mapping (unsupervised).
    """
    out: dict[str, DataFrame] = {}
    raw = contingency(frames, ["split"], unknown)
    if clusters:
        learnt = cluster_map(contingency(frames.where("split = 'train'"), (), unknown), clusters, (), unknown)
        if frames.where("split = 'train'").isEmpty():
            out["mapping"] = cluster_map(raw, clusters, ["split"], unknown)
            mapped = apply_map(frames, out["mapping"], ["split"])
        else:
            out["mapping"] = learnt
            mapped = apply_map(frames, learnt)
        out["consistency"] = f1_consistency(frames.where("split = 'train'"), known, clusters, unknown)
        out["individualised"] = reduce(DataFrame.unionByName, [individualised(frames.where(F.col("split") == s), known, clusters, unknown).withColumn("split", F.lit(s)) for s in ("train", "val", "test")])
    else:
        mapped = supervised(frames)
    counts = contingency(mapped, ["split"], unknown)
    out["labels"] = label_scores(counts, known, ["split"]).withColumns({"truth": F.col("tp") + F.col("fn"), "predicted": F.col("tp") + F.col("fp")})
    out["confusion"] = confusion(counts, known, ["split"])
    out["overall"] = scored(mapped, known, ["split"], unknown, sr, overall_target).join(homogeneity(raw, ["split"]), "split", "left")
    keys = ["split", "individual_id"]
    goal = frames.select(*keys).distinct().join(targets, "individual_id") if targets is not None else overall_target
    out["individual"] = scored(mapped, known, keys, unknown, sr, goal)
    return out
