"""The registered queries: each operator over the driver's tables, beside SQL that gives the same rows.

Recordings are stood for by `events` (a clip for each user, one channel), `embeddings` (a triad for each label) and `lineitem` (a clip for each
supplier, three channels). Results are rounded where sums of doubles may differ in their last digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions import expr, lineage
from tidewake.operators import basins, crossval, embedding, evaluate, features, losses, models, neighbours, runs, signal, training
from tidewake.operators import frames as fr
from tidewake.plans import config
from tidewake.sources import clips

KNOWN = [1, 2, 3, 4]
CLUSTERS = 20
SR = 2.0
TARGET = 0.75
HALF = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id"), F.col("user_id").alias("individual_id"), "ts", "event_id", "event_type", "value")
    label = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "signup", 3).when(F.col("event_type") == "purchase", 4).otherwise(0)
    e = e.withColumns({"label": label, "pred": (F.floor(F.col("value") / 10) % CLUSTERS).cast("int"), "fold": (F.col("clip_id") % 5).cast("int")})
    return fr.with_time(e, "clip_id", ["ts", "event_id"]).drop("ts", "event_id", "event_type")


def supervised_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.supervised(events(spark, sf_dir).withColumn("pred", F.col("pred") % 5))


def triaxial(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("clip_id"), "vec_id", *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(("AccX", "AccY", "AccZ"))))
    return fr.with_time(e, "clip_id", ["vec_id"]).withColumns({"individual_id": F.col("clip_id"), "label": (F.col("vec_id") % 5).cast("int")}).drop("vec_id")


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("clip_id"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    li = fr.with_time(li, "clip_id", ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"])
    return li.select("clip_id", "t", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("clip_id"), "vec_id", "embedding")
    e = fr.with_time(e, "clip_id", ["vec_id"])
    return e.select("clip_id", "t", F.col("clip_id").alias("individual_id"), F.col("clip_id").cast("int").alias("label"), array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and -0.0 as 0.0."""
    return df.select(*(((F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c)) for c, t in df.dtypes))


_REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _REGISTRY[f.__name__] = (lambda s, d: rounded(f(s, d)), sql)
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _REGISTRY.items() if s}


# Views that the SQL starts from.
_F = """f AS (SELECT user_id AS clip_id, user_id AS individual_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
 CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END AS label,
 CAST(floor(value / 10) AS BIGINT) % 20 AS pred, user_id % 5 AS fold, value FROM events)"""
_S = _F + ", s AS (SELECT * REPLACE (CASE WHEN pred % 5 = 0 THEN 1 ELSE pred % 5 END AS pred) FROM f)"
_K = "k AS (SELECT unnest([1, 2, 3, 4]) AS label)"
_N = "n AS (SELECT user_id AS u, count(*) AS n FROM events GROUP BY 1)"
_X = "x AS (SELECT label AS clip_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, CAST(embedding[1] AS DOUBLE) AS ax, CAST(embedding[2] AS DOUBLE) AS ay, CAST(embedding[3] AS DOUBLE) AS az FROM embeddings)"
_PATH = "CAST(clip_id AS VARCHAR) || '.csv'"
_SPLIT = "CASE WHEN fold = 0 THEN 'test' WHEN fold = 1 THEN 'val' ELSE 'train' END"
_MAP = _F + """, c AS (SELECT pred, label, count(*) AS n FROM f WHERE label <> 0 GROUP BY ALL),
 m AS (SELECT g.pred, coalesce(arg_min(c.label, (-c.n, c.label)), 0) AS mapped FROM (SELECT unnest(range(20)) AS pred) g LEFT JOIN c USING (pred) GROUP BY g.pred),
 fm AS (SELECT f.* REPLACE (m.mapped AS pred) FROM f JOIN m USING (pred))"""


def _prf(view: str, keys: str = "", name: str = "") -> str:
    """Scores by label of a view, for keys (with a comma after each)."""
    grid = f"SELECT DISTINCT {keys} k.label FROM {view}, k WHERE {view}.label <> 0" if keys else "SELECT label FROM k"
    using = f"({keys} label)" if keys else "(label)"
    return f"""{name}sc AS (SELECT {keys} label, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM ({grid}) g LEFT JOIN (
 SELECT {keys} label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
  SELECT {keys} label, CASE WHEN label = pred THEN 1 ELSE 0 END AS tp, 0 AS fp, CASE WHEN label <> pred THEN 1 ELSE 0 END AS fn FROM {view} WHERE label <> 0
  UNION ALL SELECT {keys} pred AS label, 0, CASE WHEN label <> pred THEN 1 ELSE 0 END, 0 FROM {view} WHERE label <> 0) u GROUP BY {keys} label) a USING {using}),
 {name}pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 1.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS f1 FROM {name}sc)"""


def _macro(name: str = "", keys: str = "") -> str:
    return f"SELECT {keys} round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM {name}pr" + (f" GROUP BY {keys.rstrip(', ')}" if keys else "")


# -- splits, subsets, weights


@query(f"WITH {_F} SELECT {_SPLIT} AS split, count(*) AS n, count(DISTINCT clip_id) AS clips FROM f GROUP BY 1")
def split_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Default splits by fold."""
    f = events(spark, d)
    clips = f.select("clip_id", "fold").distinct()
    return fr.assign_split(f.drop("fold"), clips, config.folds(5)).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("clip_id").alias("clips"))


@query(f"WITH {_F} SELECT CASE WHEN fold = 0 THEN 'test' WHEN fold = 4 THEN 'train' ELSE 'val' END AS split, count(*) AS n FROM f GROUP BY 1")
def low_data_split(spark: SparkSession, d: str) -> DataFrame:
    f = events(spark, d)
    return fr.assign_split(f.drop("fold"), f.select("clip_id", "fold").distinct(), config.folds(5, [0], low_data=True)).groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS clip_id, 'no samples' AS fault FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events) UNION ALL SELECT DISTINCT user_id, 'no metadata' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def split_completeness_anti(spark: SparkSession, d: str) -> DataFrame:
    return fr.unmatched_clips(events(spark, d), table(spark, d, "customer").select(F.col("c_custkey").alias("clip_id")))


@query(f"WITH {_X} SELECT clip_id, t, round(ax, 6) AS \"AccX\", round(az, 6) AS \"AccZ\" FROM x")
def channel_projection(spark: SparkSession, d: str) -> DataFrame:
    return fr.project(triaxial(spark, d), ["AccX", "AccY", "AccZ"], ["AccZ", "AccX"]).drop("individual_id", "label")


@query(f"WITH {_F} SELECT clip_id, t, label FROM f WHERE label <> 0")
def annotated_samples(spark: SparkSession, d: str) -> DataFrame:
    return fr.annotated(events(spark, d)).select("clip_id", "t", "label")


@query(f"WITH {_F} SELECT clip_id, t, round(value, 6) AS value FROM f WHERE t % 7 = 0")
def stride_per_clip(spark: SparkSession, d: str) -> DataFrame:
    return fr.every_nth(events(spark, d), 7).select("clip_id", "t", "value")


@query(f"WITH {_F}, i AS (SELECT *, row_number() OVER (ORDER BY {_PATH}, t) - 1 AS index FROM f) SELECT clip_id, t, index FROM i WHERE index % 7 = 0")
def stride_global(spark: SparkSession, d: str) -> DataFrame:
    return fr.every_nth_overall(events(spark, d), 7).select("clip_id", "t", "index")


@query(f"WITH {_F}, i AS (SELECT *, row_number() OVER (ORDER BY {_PATH}, t) - 1 AS index FROM f WHERE label <> 0) SELECT clip_id, t, index FROM i WHERE index % 5 = 0")
def stride_annotated(spark: SparkSession, d: str) -> DataFrame:
    return fr.every_nth_annotated(events(spark, d), 5).select("clip_id", "t", "index")


@query(f"WITH {_F}, {_N} SELECT clip_id, t FROM f JOIN n ON u = clip_id WHERE t < n - n % 16")
def tail_truncate(spark: SparkSession, d: str) -> DataFrame:
    return fr.whole_windows(events(spark, d), 16).select("clip_id", "t")


@query(f"WITH {_F}, {_N}, i AS (SELECT *, row_number() OVER (ORDER BY {_PATH}, t) - 1 AS index FROM f JOIN n ON u = clip_id WHERE t < n - 16) SELECT clip_id, t, index FROM i WHERE index % 4 = 0")
def window_starts_stride(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth window of the validation loader."""
    return fr.every_nth_overall(fr.window_starts(events(spark, d), 16), 4).select("clip_id", "t", "index")


@query(f"WITH {_F}, {_N} SELECT clip_id, t FROM (SELECT *, max(CASE WHEN label <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS a FROM f JOIN n ON u = clip_id) WHERE a = 1 AND t < n - 2")
def annotated_windows(spark: SparkSession, d: str) -> DataFrame:
    return fr.annotated_starts(events(spark, d), 2).select("clip_id", "t")


@query(f"WITH {_F}, {_N} SELECT clip_id, t, round(list_sum(v), 6) AS total FROM (SELECT *, list(value) OVER (PARTITION BY clip_id ORDER BY t ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS v FROM f JOIN n ON u = clip_id) WHERE t < n - 8")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return fr.sliding_windows(events(spark, d), 8, "value").select("clip_id", "t", F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"WITH {_F} SELECT clip_id, t // 16 AS chunk, count(*) AS n, round(sum(value) + (16 - count(*)) * avg(value), 6) AS total FROM f GROUP BY 1, 2")
def tumbling_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of inference, the last one filled with the mean."""
    return fr.tumbling(events(spark, d), 16, ["value"]).select("clip_id", "chunk", "n", F.aggregate("value", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"WITH {_F} SELECT a.clip_id, a.t, round(sum(b.value), 6) AS total FROM f a, unnest(range(6)) g(j), f b WHERE b.clip_id = a.clip_id AND b.t = abs(a.t - g.j) GROUP BY ALL")
def trailing_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows up to each row, mirrored before the clip begins."""
    return fr.trailing_windows(events(spark, d), 6, "value").select("clip_id", "t", F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"))


def _key() -> F.Column:
    return (F.col("t") * 7919 + F.col("individual_id") * 104729) % 100003


_BAL = _F + """, g AS (SELECT i.individual_id, k.label, count(f.t) AS n FROM (SELECT DISTINCT individual_id FROM f) i CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS label) k
 LEFT JOIN f ON f.individual_id = i.individual_id AND f.label = k.label GROUP BY ALL), l AS (SELECT individual_id, min(n) AS least FROM g GROUP BY 1),
 b AS (SELECT clip_id, t, label FROM (SELECT *, row_number() OVER (PARTITION BY individual_id, label ORDER BY (t * 7919 + individual_id * 104729) % 100003, clip_id, t) AS r FROM f WHERE label <> 0) JOIN l USING (individual_id) WHERE r <= least)"""


@query(f"WITH {_BAL} SELECT * FROM b")
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    return fr.balanced(events(spark, d), KNOWN, _key()).select("clip_id", "t", "label")


@query(f"WITH {_BAL} SELECT individual_id, label, n FROM g")
def balanced_sample_counts(spark: SparkSession, d: str) -> DataFrame:
    return fr.label_grid(events(spark, d), KNOWN).select("individual_id", "label", "n")


@query(f"WITH {_BAL} SELECT f.clip_id, f.t, coalesce(b.label, 0) AS label FROM f LEFT JOIN b USING (clip_id, t)")
def balanced_mask(spark: SparkSession, d: str) -> DataFrame:
    return fr.balanced_mask(events(spark, d), KNOWN, 0, _key()).select("clip_id", "t", "label")


@query(f"WITH {_F} SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM f WHERE label <> 0), 6) AS proportion FROM f GROUP BY 1")
def class_proportions(spark: SparkSession, d: str) -> DataFrame:
    return fr.class_proportions(events(spark, d))


@query(f"WITH {_F}, c AS (SELECT label, count(*) AS n FROM f WHERE label <> 0 GROUP BY 1), s AS (SELECT sum(n) AS a, count(*) AS k FROM c) SELECT label, round(1 / (n / a + 1e-6), 6) AS inverse_weight, round(a / (k * n), 6) AS balanced_weight FROM c, s")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return fr.class_weights(events(spark, d))


# -- evaluation


@query(f"WITH {_F} SELECT pred, label, count(*) AS n FROM f WHERE label <> 0 GROUP BY ALL")
def contingency(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.contingency(events(spark, d))


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    f = events(spark, d)
    return evaluate.apply_map(f, evaluate.cluster_map(evaluate.contingency(f), CLUSTERS))


@query(f"WITH {_MAP} SELECT pred, mapped AS label FROM m")
def map_mapping(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.cluster_map(evaluate.contingency(events(spark, d)), CLUSTERS)


@query(f"WITH {_MAP}, {_K} SELECT a.label, b.label AS pred, (SELECT count(*) FROM fm WHERE fm.label = a.label AND fm.pred = b.label) AS n FROM k a, k b")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(evaluate.contingency(_mapped(spark, d)), KNOWN)


@query(f"WITH {_MAP}, {_K}, {_prf('fm')} SELECT label, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pr")
def prf_overall(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.label_scores(evaluate.contingency(_mapped(spark, d)), KNOWN)


@query(f"WITH {_S}, {_K}, {_prf('s')} SELECT label, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pr")
def prf_supervised(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.label_scores(evaluate.contingency(supervised_events(spark, d)), KNOWN)


@query(f"WITH {_MAP}, {_K}, {_prf('fm', 'individual_id,')} {_macro('', 'individual_id, ')}")
def prf_individual(spark: SparkSession, d: str) -> DataFrame:
    keys = ["individual_id"]
    return evaluate.macro_scores(evaluate.label_scores(evaluate.contingency(_mapped(spark, d), keys), KNOWN, keys), keys)


_OWN = _F + """, c AS (SELECT individual_id, pred, label, count(*) AS n FROM f WHERE label <> 0 GROUP BY ALL),
 m AS (SELECT individual_id, pred, arg_min(label, (-n, label)) AS mapped FROM c GROUP BY ALL),
 fm AS (SELECT f.* REPLACE (coalesce(m.mapped, 0) AS pred) FROM f LEFT JOIN m ON m.individual_id = f.individual_id AND m.pred = f.pred)"""


@query(f"WITH {_OWN}, {_K}, {_prf('fm', 'individual_id,')} {_macro('', 'individual_id, ')}")
def prf_individualised(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.individualised(events(spark, d), KNOWN, CLUSTERS)


@query(f"WITH {_OWN}, {_K}, {_prf('fm', 'individual_id,')} SELECT label, round(avg(f1), 6) AS mean_f1_individualised FROM pr GROUP BY 1")
def f1_consistency(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.f1_consistency(events(spark, d), KNOWN, CLUSTERS)


@query(f"WITH {_MAP}, {_K} SELECT label, (SELECT count(*) FROM fm WHERE fm.label = k.label) AS truth, (SELECT count(*) FROM fm WHERE fm.pred = k.label AND fm.label <> 0) AS predicted FROM k")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.label_counts(evaluate.contingency(_mapped(spark, d)), KNOWN)


_HOMOG = """c AS (SELECT individual_id AS g, pred, label, CAST(count(*) AS DOUBLE) AS n FROM f WHERE label <> 0 GROUP BY ALL),
 w AS (SELECT *, sum(n) OVER (PARTITION BY g) AS a, sum(n) OVER (PARTITION BY g, pred) AS k, sum(n) OVER (PARTITION BY g, label) AS l FROM c),
 h AS (SELECT g, sum(-n / a * ln(n / k)) AS hck, sum(-n / a * ln(l / a)) AS hc FROM w GROUP BY g)"""


@query(f"WITH {_F}, {_HOMOG.replace('individual_id AS g', '0 AS g')} SELECT round(CASE WHEN hc < 1e-14 THEN 1 ELSE 1 - hck / hc END, 6) AS homogeneity FROM h")
def homogeneity(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.homogeneity(evaluate.contingency(events(spark, d)))


@query(f"WITH {_F}, {_HOMOG} SELECT g AS individual_id, round(CASE WHEN hc < 1e-14 THEN 1 ELSE 1 - hck / hc END, 6) AS homogeneity FROM h")
def homogeneity_individual(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.homogeneity(evaluate.contingency(events(spark, d), ["individual_id"]), ["individual_id"])


@query(f"WITH {_MAP} SELECT individual_id, count(*) AS rows, CAST(1 + sum(CASE WHEN pred <> p THEN 1 ELSE 0 END) AS BIGINT) AS bouts FROM (SELECT *, lag(pred) OVER (PARTITION BY individual_id ORDER BY {_PATH}, t) AS p FROM fm) GROUP BY 1")
def bouts(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.bouts(_mapped(spark, d), ["individual_id"])


@query(f"WITH {_MAP} SELECT fold, count(*) AS rows, CAST(1 + sum(CASE WHEN pred <> p THEN 1 ELSE 0 END) AS BIGINT) AS bouts FROM (SELECT *, lag(pred) OVER (PARTITION BY fold ORDER BY {_PATH}, t) AS p FROM fm) GROUP BY 1")
def bouts_over_clips(spark: SparkSession, d: str) -> DataFrame:
    """A change where two clips of a group meet counts too."""
    return evaluate.bouts(_mapped(spark, d), ["fold"])


@query("SELECT c.conv_id AS clip_id, count(*) AS rows, CAST(1 + sum(CASE WHEN p <> r THEN 1 ELSE 0 END) AS BIGINT) AS bouts FROM (SELECT conv_id, length(role) AS r, lag(length(role)) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) c GROUP BY 1")
def bouts_conversations(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("clip_id"), F.col("turn").alias("t"), F.length("role").alias("pred"))
    return evaluate.bouts(c, ["clip_id"])


@query(f"WITH {_MAP} SELECT individual_id, round(count(*) / (1 + sum(CASE WHEN pred <> p THEN 1 ELSE 0 END)) / 2.0 / 0.75, 6) AS time_scale_ratio FROM (SELECT *, lag(pred) OVER (PARTITION BY individual_id ORDER BY {_PATH}, t) AS p FROM fm) GROUP BY 1")
def time_scale_ratio(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.time_scale_ratio(_mapped(spark, d), SR, TARGET, ["individual_id"])


@query("WITH g AS (SELECT CAST(quality AS INT) + 1 AS label, CAST(toxic AS INT) + 1 AS pred FROM labels), k AS (SELECT unnest([1, 2]) AS label) SELECT round(avg(r), 6) AS accuracy FROM (SELECT label, avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS r FROM g GROUP BY 1)")
def masked_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Of toxic as a guess of quality, both shifted by one."""
    g = table(spark, d, "labels").select((F.col("quality") + 1).cast("int").alias("label"), (F.col("toxic") + 1).cast("int").alias("pred"))
    return evaluate.masked_accuracy(g, [1, 2])


def _evaluated(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    f = events(spark, d)
    f = fr.assign_split(f.drop("fold"), f.select("clip_id", "fold").distinct(), config.folds(5))
    return evaluate.evaluate(f, KNOWN, CLUSTERS, sr=SR, overall_target=TARGET)


_EV = _F + f""", sf AS (SELECT *, {_SPLIT} AS split FROM f), c AS (SELECT pred, label, count(*) AS n FROM sf WHERE label <> 0 AND split = 'train' GROUP BY ALL),
 m AS (SELECT g.pred, coalesce(arg_min(c.label, (-c.n, c.label)), 0) AS mapped FROM (SELECT unnest(range(20)) AS pred) g LEFT JOIN c USING (pred) GROUP BY g.pred),
 fm AS (SELECT sf.* REPLACE (m.mapped AS pred) FROM sf JOIN m USING (pred))"""


@query(f"WITH {_EV}, {_K}, {_prf('fm', 'split, individual_id,')}, a AS ({_macro('', 'split, individual_id, ')}), b AS (SELECT split, individual_id, round(count(*) / (1 + sum(CASE WHEN pred <> p THEN 1 ELSE 0 END)) / 2.0 / 0.75, 6) AS time_scale_ratio FROM (SELECT *, lag(pred) OVER (PARTITION BY individual_id ORDER BY {_PATH}, t) AS p FROM fm) GROUP BY ALL) SELECT *, macro_f1 IS NOT NULL AS annotated FROM b LEFT JOIN a USING (split, individual_id)")
def standalone_individual(spark: SparkSession, d: str) -> DataFrame:
    """The whole evaluation of predictions: the map is learnt on train and scores each individual of every split."""
    return _evaluated(spark, d)["individual"]


@query(f"WITH {_EV}, {_K}, {_prf('fm', 'split,')} SELECT split, label, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pr")
def standalone_labels(spark: SparkSession, d: str) -> DataFrame:
    return _evaluated(spark, d)["labels"].drop("truth", "predicted")


@query(f"WITH {_EV}, {_K}, {_prf('fm', 'split,')}, a AS ({_macro('', 'split, ')}), b AS (SELECT split, round(count(*) / (1 + sum(CASE WHEN pred <> p THEN 1 ELSE 0 END)) / 2.0 / 0.75, 6) AS time_scale_ratio FROM (SELECT *, lag(pred) OVER (PARTITION BY split ORDER BY {_PATH}, t) AS p FROM fm) GROUP BY ALL), f2 AS (SELECT *, split AS s2 FROM sf), {_HOMOG.replace('individual_id AS g', 's2 AS g').replace('c AS (', 'hh AS (').replace('FROM f WHERE', 'FROM f2 WHERE').replace('FROM c)', 'FROM hh)')} SELECT b.split, time_scale_ratio, macro_precision, macro_recall, macro_f1, true AS annotated, round(CASE WHEN hc < 1e-14 THEN 1 ELSE 1 - hck / hc END, 6) AS homogeneity FROM b JOIN a USING (split) JOIN h ON h.g = b.split")
def standalone_overall(spark: SparkSession, d: str) -> DataFrame:
    """Scores of each split as one group: bouts go on over its clips, homogeneity is of raw predictions."""
    return _evaluated(spark, d)["overall"]


@query(f"WITH {_MAP}, g AS (SELECT c_custkey AS individual_id, 0.5 + c_nationkey / 10.0 AS goal FROM customer) SELECT individual_id, round(count(*) / (1 + sum(CASE WHEN pred <> p THEN 1 ELSE 0 END)) / 2.0 / any_value(goal), 6) AS time_scale_ratio FROM (SELECT *, lag(pred) OVER (PARTITION BY individual_id ORDER BY {_PATH}, t) AS p FROM fm) JOIN g USING (individual_id) GROUP BY 1")
def time_scale_targets(spark: SparkSession, d: str) -> DataFrame:
    """Each individual against a target of its own, from a table."""
    goals = table(spark, d, "customer").select(F.col("c_custkey").alias("individual_id"), (F.lit(0.5) + F.col("c_nationkey") / 10).alias("mean_dur_sec"))
    return evaluate.time_scale_ratio(_mapped(spark, d), SR, goals, ["individual_id"])


@query(f"WITH {_MAP} SELECT t, round(value, 6) AS value, label, pred FROM fm WHERE clip_id = (SELECT min(user_id) FROM events) AND t BETWEEN 2 AND 9")
def track_rows(spark: SparkSession, d: str) -> DataFrame:
    """A clip's signals, labels and predictions between two times."""
    e = _mapped(spark, d)
    return clips.track(e, table(spark, d, "events").agg(F.min("user_id")).first()[0], 2, 9, ["value"])


# -- cross-validation


_CV = f"{_MAP}, {_K}, {_prf('fm', 'individual_id,')}, a AS ({_macro('', 'individual_id, ')}), b AS (SELECT *, CASE WHEN individual_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM a)"


@query(f"WITH {_CV} SELECT split, round(avg(macro_f1), 5) AS f1_mean, round(stddev_pop(macro_f1), 5) AS f1_std, round(avg(macro_precision), 5) AS prec_mean, round(stddev_pop(macro_precision), 5) AS prec_std, round(avg(macro_recall), 5) AS rec_mean, round(stddev_pop(macro_recall), 5) AS rec_std FROM b GROUP BY 1")
def crossval_summary(spark: SparkSession, d: str) -> DataFrame:
    i = rounded(prf_individual(spark, d)).withColumn("split", F.when(F.col("individual_id") % 5 == 0, "test").otherwise("train"))
    return rounded(crossval.summary(i), 5)


@query(f"WITH {_MAP}, {_K}, g AS (SELECT a.label, b.label AS pred FROM k a, k b), q AS (SELECT label, pred, count(*) AS n FROM fm GROUP BY ALL), cc AS (SELECT label, pred, coalesce(n, 0) AS n FROM g LEFT JOIN q USING (label, pred)) SELECT label, pred, n, round(n / sum(n) OVER (), 6) AS share, round(coalesce(n / nullif(sum(n) OVER (PARTITION BY label), 0), 0), 6) AS row_share FROM cc")
def confusion_crossfold_norm(spark: SparkSession, d: str) -> DataFrame:
    c = evaluate.confusion(evaluate.contingency(_mapped(spark, d), ["fold"]), KNOWN, ["fold"])
    return crossval.summed_confusion(c)


@query(f"WITH {_F} SELECT label, pred, round(n / sum(n) OVER (PARTITION BY pred), 6) AS share FROM (SELECT label, pred, count(*) AS n FROM f WHERE label <> 0 GROUP BY ALL)")
def confusion_pred_norm(spark: SparkSession, d: str) -> DataFrame:
    return crossval.by_prediction(evaluate.contingency(events(spark, d)))


@query(f"WITH {_MAP}, {_K}, {_prf('fm', 'fold,')} SELECT label, CAST(sum(tp + fn) AS BIGINT) AS truth, CAST(sum(tp + fp) AS BIGINT) AS predicted, 'test' AS split FROM pr GROUP BY 1")
def label_counts_crossfold(spark: SparkSession, d: str) -> DataFrame:
    c = evaluate.label_counts(evaluate.contingency(_mapped(spark, d), ["fold"]), KNOWN, ["fold"]).withColumn("split", F.lit("test"))
    return crossval.summed_labels(c)


@query(f"WITH {_CV} SELECT individual_id % 7 AS config_id, round(avg(macro_f1), 6) AS score FROM b GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def best_config(spark: SparkSession, d: str) -> DataFrame:
    return crossval.best(rounded(prf_individual(spark, d)).withColumn("config_id", F.col("individual_id") % 7))


@query("SELECT n_nationkey AS config_id FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def resume_anti(spark: SparkSession, d: str) -> DataFrame:
    """Configurations without a result."""
    return crossval.pending(table(spark, d, "nation").select(F.col("n_nationkey").alias("config_id")), table(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("config_id")))


@query("SELECT row_number() OVER (ORDER BY p.v, f.v, s.v) - 1 AS config_id, f.v AS flag, p.v AS \"Priority\", s.v AS status FROM (SELECT DISTINCT l_returnflag AS v FROM lineitem) f, (SELECT DISTINCT o_orderpriority AS v FROM orders) p, (SELECT DISTINCT l_linestatus AS v FROM lineitem) s")
def grid_cross_join(spark: SparkSession, d: str) -> DataFrame:
    """All points of a grid over values that tables hold; keys in code-point order, the last one fastest."""
    values = lambda t, c: [r[0] for r in table(spark, d, t).select(c).distinct().orderBy(c).collect()]  # noqa: E731  a few values
    points = config.expand({"flag": values("lineitem", "l_returnflag"), "Priority": values("orders", "o_orderpriority"), "status": values("lineitem", "l_linestatus")})
    return spark.createDataFrame([(k, p["flag"], p["Priority"], p["status"]) for k, p in enumerate(points)], "config_id long, flag string, Priority string, status string")


@query("SELECT DISTINCT p_size AS id, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 8 END AS temporal, 50 AS iterations, CASE WHEN p_size % 3 = 0 THEN 'full' ELSE 'diagonal' END AS covariance, p_size % 5 = 0 AS low_data FROM part".replace("ELSE 8", "ELSE 2500"))
def defaults_merge(spark: SparkSession, d: str) -> DataFrame:
    """Given values win over a model's defaults, also inside model_config; the values are those of a table."""
    sizes = [r[0] for r in table(spark, d, "part").select("p_size").distinct().collect()]  # 50 at most
    rows = []
    for k in sizes:
        own = ({"temporal_window_samples": k} if k % 2 == 0 else {}) | ({"covariance": "full"} if k % 3 == 0 else {})
        full = config.with_defaults({"model": "hmm", "model_config": own} | ({"low_data_setting": True} if k % 5 == 0 else {}))
        m = full["model_config"]
        rows.append((k, m["temporal_window_samples"], m["N_iters"], m["covariance"], full["low_data_setting"]))
    return spark.createDataFrame(rows, "id int, temporal int, iterations int, covariance string, low_data boolean")


# -- framed features

_W = "OVER (PARTITION BY clip_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"
_PAIRS = "x AS (SELECT a.clip_id, a.t, b.t AS bt, b.{v} AS v, CASE WHEN b.t > greatest(a.t - 5, 0) THEN c.{v} END AS l FROM {f} a JOIN {f} b ON a.clip_id = b.clip_id AND b.t BETWEEN a.t - 5 AND a.t + 5 LEFT JOIN {f} c ON c.clip_id = b.clip_id AND c.t = b.t - 1)"
_MOM = """s AS (SELECT clip_id, t, count(*) AS n, avg(v) AS m, stddev_samp(v) AS sd, max(v) AS hi, min(v) AS lo, avg(bt) AS mt FROM x GROUP BY ALL),
 z AS (SELECT s.clip_id, s.t, any_value(n) AS n, any_value(m) AS m, any_value(sd) AS sd, any_value(hi) AS hi, any_value(lo) AS lo, avg(power((v - m) / (sd + 1e-12), 3)) AS sk, avg(power((v - m) / (sd + 1e-12), 4)) - 3 AS ku,
  avg((v - m) * (l - m)) / (any_value(sd) * any_value(sd) + 1e-12) AS ac, sum((bt - mt) * (v - m)) AS tr FROM s JOIN x USING (clip_id, t) GROUP BY ALL)"""


def _frame_sql(view: str, source: str, value: str, columns: str) -> str:
    return f"WITH {view}, {_PAIRS.format(v=value, f=source)}, {_MOM} SELECT clip_id, t, {columns} FROM z".replace("x AS (SELECT a.clip_id", "xx AS (SELECT a.clip_id").replace("FROM x GROUP", "FROM xx GROUP").replace("JOIN x USING", "JOIN xx USING")


@query(_frame_sql(_F, "f", "value", "round(m, 6) AS value_mean, round(sd, 6) AS value_std, round(hi, 6) AS value_max, round(lo, 6) AS value_min, round(tr, 4) AS value_trend"))
def frame_basic(spark: SparkSession, d: str) -> DataFrame:
    r = features.channel_features(events(spark, d), ["value"], HALF, ("mean", "std", "max", "min", "trend"))
    return r.withColumn("value_trend", F.round("value_trend", 4) + 0.0)


@query(_frame_sql(_F, "f", "value", "round(sk, 5) AS value_skew, round(ku, 5) AS value_kurt"))
def frame_skew_kurt(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.channel_features(events(spark, d), ["value"], HALF, ("skew", "kurt")), 5)


@query(_frame_sql(_F, "f", "value", "round(ac, 6) AS value_autocorr"))
def frame_autocorr(spark: SparkSession, d: str) -> DataFrame:
    return features.channel_features(events(spark, d), ["value"], HALF, ("autocorr",))


_SUP = "f AS (SELECT l_suppkey AS clip_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS t, l_quantity AS quantity, l_extendedprice AS price FROM lineitem)"


@query(f"WITH {_SUP} SELECT clip_id, t, round(avg(quantity) {_W}, 6) AS quantity_mean, round(avg(price) {_W}, 4) AS price_mean, round(stddev_samp(quantity) {_W}, 6) AS quantity_std, round(stddev_samp(price) {_W}, 4) AS price_std, max(quantity) {_W} AS quantity_max, max(price) {_W} AS price_max, min(quantity) {_W} AS quantity_min, min(price) {_W} AS price_min FROM f")
def frame_features_large(spark: SparkSession, d: str) -> DataFrame:
    """Two channels of the largest table, all in one window."""
    r = features.channel_features(supplies(spark, d), ["quantity", "price"], HALF, ("mean", "std", "max", "min"))
    return r.withColumns({c: F.round(c, 4) + 0.0 for c in ("price_mean", "price_std")})


def _corr(a: str, b: str) -> str:
    return f"round(count(*) {_W} * covar_pop({a}, {b}) {_W} / (count(*) {_W} * sqrt(var_pop({a}) {_W} * var_pop({b}) {_W}) + 1e-12), 6)"


@query(f"WITH {_X} SELECT clip_id, t, {_corr('ax', 'ay')} AS xy, {_corr('ax', 'az')} AS xz, {_corr('ay', 'az')} AS yz FROM x")
def triax_corr(spark: SparkSession, d: str) -> DataFrame:
    f, x = features.Frame(HALF), triaxial(spark, d)
    c = [f.corr("AccX", "AccY").alias("xy"), f.corr("AccX", "AccZ").alias("xz"), f.corr("AccY", "AccZ").alias("yz")]
    return f.over(x).select("clip_id", "t", *c)


def _circ(a: str) -> str:
    return f"round(1 - sqrt(power(sum(cos({a})) {_W}, 2) + power(sum(sin({a})) {_W}, 2)) / count(*) {_W}, 6)"


@query(f"WITH {_X}, a AS (SELECT *, acos(az / (sqrt(ax * ax + ay * ay + az * az) + 1e-12)) AS i, atan(ay / (az + 1e-12)) AS z FROM x) SELECT clip_id, t, {_circ('i')} AS inclination, {_circ('z')} AS azimuth FROM a")
def circular_variance(spark: SparkSession, d: str) -> DataFrame:
    f, x = features.Frame(HALF), triaxial(spark, d).withColumn("q", expr.norm("AccX", "AccY", "AccZ"))
    c = [f.circular_variance(expr.inclination(F.col("AccZ"), F.col("q")), "inclination").alias("inclination"), f.circular_variance(expr.azimuth(F.col("AccY"), F.col("AccZ")), "azimuth").alias("azimuth")]
    return f.over(x).select("clip_id", "t", *c)


@query(f"WITH {_X} SELECT clip_id, t, round(avg(abs(ax) + abs(ay) + abs(az)) {_W}, 6) AS dynamic FROM x")
def dynamic_accel(spark: SparkSession, d: str) -> DataFrame:
    f = features.Frame(HALF)
    mean = f.dynamic(["AccX", "AccY", "AccZ"]).alias("dynamic")
    return f.over(triaxial(spark, d)).select("clip_id", "t", mean)


@query(f"WITH {_X} SELECT clip_id, t, round(sqrt(ax * ax + ay * ay + az * az), 6) AS q FROM x")
def acc_norm(spark: SparkSession, d: str) -> DataFrame:
    return triaxial(spark, d).select("clip_id", "t", expr.norm("AccX", "AccY", "AccZ").alias("q"))


@query()
def feature_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The whole feature set of a triad (38 values a row)."""
    x = triaxial(spark, d)
    return features.feature_set(x, ["AccX", "AccY", "AccZ"], HALF, dynamic_only=True)


# -- signals


@query(f"WITH {_X}, m AS (SELECT clip_id, avg(sqrt(ax * ax + ay * ay + az * az)) AS g FROM x GROUP BY 1) SELECT clip_id, t, round(ax / (g + 1e-6), 6) AS \"AccX\", round(ay / (g + 1e-6), 6) AS \"AccY\", round(az / (g + 1e-6), 6) AS \"AccZ\" FROM x JOIN m USING (clip_id)")
def acc_scale(spark: SparkSession, d: str) -> DataFrame:
    return signal.scale_acceleration(triaxial(spark, d), ["AccX", "AccY", "AccZ"]).select("clip_id", "t", "AccX", "AccY", "AccZ")


@query(f"WITH {_F} SELECT clip_id, t, round((value - avg(value) OVER (PARTITION BY clip_id)) / (stddev_pop(value) OVER (PARTITION BY clip_id) + 1e-6), 6) AS value FROM f")
def zscore_clip(spark: SparkSession, d: str) -> DataFrame:
    return signal.z_clip(events(spark, d), ["value"]).select("clip_id", "t", "value")


@query(f"WITH {_F}, g AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM f WHERE fold >= 2) SELECT clip_id, t, round((value - m) / s, 6) AS value FROM f, g")
def zscore_train(spark: SparkSession, d: str) -> DataFrame:
    f = events(spark, d)
    return signal.z_by(f, signal.moments(f.where("fold >= 2"), ["value"]), ["value"]).select("clip_id", "t", "value")


_FIR = """h AS (SELECT k, r / sum(r * cos(pi() * m)) OVER () AS h FROM (SELECT k, k - 5 AS m, (CASE WHEN k = 5 THEN 1 ELSE sin(pi() * (k - 5)) / (pi() * (k - 5)) END - 0.4 * CASE WHEN k = 5 THEN 1 ELSE sin(pi() * 0.4 * (k - 5)) / (pi() * 0.4 * (k - 5)) END)
  * (0.54 - 0.46 * cos(2 * pi() * k / 10)) AS r FROM (SELECT unnest(range(11)) AS k)))"""


@query(f"""WITH {_F}, {_N}, {_FIR}, p AS (SELECT f.clip_id, f.t, f.value, h.h, n, f.t + 5 - h.k AS j FROM f JOIN n ON u = clip_id CROSS JOIN h),
 y AS (SELECT p.clip_id, p.t, any_value(p.value) AS x, sum(CASE WHEN j = -5 THEN 0 ELSE p.h * b.value END) AS dyn FROM p JOIN f b ON b.clip_id = p.clip_id AND b.t = CASE WHEN j < 0 THEN -j WHEN j > n - 1 THEN 2 * (n - 1) - j ELSE j END GROUP BY ALL)
 SELECT clip_id, t, round(x - dyn, 6) AS "AccX_static", round(dyn, 6) AS "AccX_dynamic" FROM y""")
def fir_static_dynamic(spark: SparkSession, d: str) -> DataFrame:
    """Ten samples of filter at 0.4 of Nyquist: a cut-off of 0.4 Hz at 2 samples a second needs twice as many, so time is scaled."""
    f = events(spark, d).withColumnRenamed("value", "AccX")
    return signal.filtered(f.select("clip_id", "t", "AccX"), ["AccX"], 10, 0.4)


@query()
def cwt_magnitude(spark: SparkSession, d: str) -> DataFrame:
    w = signal.wavelets(events(spark, d), ["value"], 2.0, n=5, longest=20, w=5, normalise=True, every=2)
    return w.select("clip_id", "t", *(F.col("values")[k].alias(f"w{k}") for k in range(5)))


@query()
def whitening(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    v = vectors(spark, d)
    w = signal.Whitening(8).fit(v).transform(v).withColumn("w", vector_to_array("white"))
    return w.select("clip_id", "t", *(F.col("w")[k].alias(f"w{k}") for k in range(8)))


# -- models


def _fitted(name: str, spark: SparkSession, d: str, clusters: int = 10, **settings: object) -> DataFrame:
    v = vectors(spark, d)
    m = models.model(name, clusters, 0, **settings).fit(v)
    return m.predict(v).select("clip_id", "t", "label", "pred")


@query()
def model_random(spark: SparkSession, d: str) -> DataFrame:
    return _fitted("random", spark, d)


@query()
def model_kmeans(spark: SparkSession, d: str) -> DataFrame:
    return _fitted("kmeans", spark, d, whiten=True, n_components=8)


@query()
def model_gmm(spark: SparkSession, d: str) -> DataFrame:
    return _fitted("gmm", spark, d, clusters=4)


@query()
def model_random_forest(spark: SparkSession, d: str) -> DataFrame:
    return _fitted("rf", spark, d)


@query()
def model_decision_tree(spark: SparkSession, d: str) -> DataFrame:
    return _fitted("dt", spark, d)


@query()
def model_svm(spark: SparkSession, d: str) -> DataFrame:
    return _fitted("svm", spark, d)


@query()
def model_hmm(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    f = events(spark, d).select("clip_id", "t", "label", array_to_vector(F.array("value")).alias("features"))
    m = models.model("hmm", 4, 0, temporal_window_samples=8).fit(f)
    return m.predict(f).select("clip_id", "t", "label", "pred")


@query()
def model_classic(spark: SparkSession, d: str) -> DataFrame:
    """The classic wrapper on a triad: balanced, framed, fitted on annotated rows, every row predicted."""
    from tidewake.operators.classic import Classic

    x = triaxial(spark, d)
    settings = config.with_defaults({"model": "dt", "model_config": {"context_window_sec": 5}})["model_config"]
    return Classic("dt", ["AccX", "AccY", "AccZ"], KNOWN, SR, settings, balance=True, dynamic_only=True).fit(x).predict(x)


@query("WITH " + _F + ", s AS (SELECT clip_id, t // 4 AS k, pred FROM f WHERE t % 4 = 0), m AS (SELECT clip_id, count(*) AS m FROM s GROUP BY 1), c AS (SELECT clip_id, count(*) AS n FROM f GROUP BY 1) SELECT f.clip_id, f.t, s.pred FROM f JOIN m USING (clip_id) JOIN c USING (clip_id) JOIN s ON s.clip_id = f.clip_id AND s.k = ((2 * f.t + 1) * m) // (2 * n)")
def upsampled_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions for each fourth row, spread over all rows."""
    e = events(spark, d)
    return fr.upsampled(e, fr.every_nth(e, 4), 4)


@query("WITH p AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), s AS (SELECT min(x) AS x0, min(y) AS y0, (64 - 2 * 4) / greatest(max(x) - min(x), max(y) - min(y)) AS s FROM p), c AS (SELECT CAST(least(greatest(floor((x - x0) * s) + 4, 0), 63) AS BIGINT) AS row, CAST(least(greatest(floor((y - y0) * s) + 4, 0), 63) AS BIGINT) AS col, count(*) AS n FROM p, s GROUP BY ALL) SELECT row, col, n, round(n / (SELECT max(n) FROM c), 6) AS density FROM c")
def raster_density(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "embeddings").select(*(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xy")))
    return fr.raster(p, 64, 4)


@query("WITH c AS (SELECT l_quantity::BIGINT AS row, (l_orderkey % 60)::BIGINT AS col, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT a.row, a.col, a.n, max(b.n) AS top FROM c a JOIN c b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY ALL) SELECT row, col, n FROM m WHERE n = top")
def raster_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a raster that no neighbour exceeds."""
    cells = table(spark, d, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("row"), (F.col("l_orderkey") % 60).cast("long").alias("col")).agg(F.count("*").alias("n"))
    return fr.peaks(cells)


@query(f"WITH {_F}, c AS (SELECT clip_id, count(*) AS n FROM f GROUP BY 1), w AS (SELECT a.clip_id, a.t, j, CASE WHEN a.t + j < 0 THEN -(a.t + j) WHEN a.t + j >= n THEN 2 * (n - 1) - (a.t + j) ELSE a.t + j END AS p FROM f a JOIN c USING (clip_id), unnest(range(-3, 3)) g(j)) SELECT w.clip_id, w.t, round(sum(b.value * (j + 4)), 6) AS total FROM w JOIN f b ON b.clip_id = w.clip_id AND b.t = p JOIN c ON c.clip_id = w.clip_id WHERE n > 3 GROUP BY ALL")
def centred_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows about each row, mirrored at both ends of a clip of more than half a window, summed with weights of their places."""
    w = fr.centred_windows(events(spark, d), 3, "value").where(F.size("values") == 6)
    return w.select("clip_id", "t", F.aggregate(F.transform("values", lambda x, j: x * (j + 1)), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"WITH {_F}, c AS (SELECT clip_id, count(*) AS n FROM f GROUP BY 1), w AS (SELECT a.clip_id, a.t, j, a.t + j * least(n - a.t, 8 + (a.t * 7 + a.clip_id) % 8 - 4) // 8 AS p FROM f a JOIN c USING (clip_id), unnest(range(8)) g(j) WHERE a.t < n - 8) SELECT w.clip_id, w.t, round(sum(b.value * (j + 1)), 6) AS total FROM w JOIN f b ON b.clip_id = w.clip_id AND b.t = p GROUP BY ALL")
def rescaled_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 8 rows stretched or shrunk in time by up to half, by a rule that stands for chance."""
    w = fr.rescaled_windows(events(spark, d), 8, "value", 0.5, F.pmod(F.col("t") * 7 + F.col("clip_id"), F.lit(8)) - 4)
    return w.select("clip_id", "t", F.aggregate(F.transform("values", lambda x, j: x * (j + 1)), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("WITH RECURSIVE o AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, o_orderkey AS step, CAST(o_totalprice AS DOUBLE) AS value FROM orders), s AS (SELECT run, k, step, value, value AS smoothed, value AS least, 0 AS idle, false AS stopped FROM o WHERE k = 1 UNION ALL SELECT o.run, o.k, o.step, o.value, s.smoothed * 0.75 + o.value * 0.25, least(s.least, s.smoothed * 0.75 + o.value * 0.25), CASE WHEN s.smoothed * 0.75 + o.value * 0.25 < s.least THEN 0 ELSE s.idle + 1 END, s.stopped OR CASE WHEN s.smoothed * 0.75 + o.value * 0.25 < s.least THEN 0 ELSE s.idle + 1 END >= 4 FROM s JOIN o ON o.run = s.run AND o.k = s.k + 1) SELECT run, step, round(value, 6) AS value, round(smoothed, 6) AS smoothed, idle::BIGINT AS idle, stopped FROM s")
def smoothed_losses(spark: SparkSession, d: str) -> DataFrame:
    """Moving means with patience; a customer's orders stand for a run's losses."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("loss"))
    return training.smoothed(o, "run", "k", "loss", 0.25, 4)


@query("SELECT DISTINCT t AS epoch, round(CASE WHEN t > 4 THEN least(1.0, (t - 4) / 8.0) ELSE 0 END, 6) AS linear, round(CASE WHEN t > 4 THEN 1 / (1 + exp(-0.9 * (t - 8))) ELSE 0 END, 6) AS sigmoid FROM (SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events)")
def annealed_weights(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).select(F.col("t").alias("epoch")).distinct()
    return e.select("epoch", training.annealed(F.col("epoch"), 4, 8).alias("linear"), training.annealed(F.col("epoch"), 4, 8, "sigmoid").alias("sigmoid"))


# -- metadata joins


@query("WITH " + _F + " SELECT clip_id % 10 AS individual_id, count(*) AS n, sum(t) AS places FROM f GROUP BY 1")
def individual_of_clip(spark: SparkSession, d: str) -> DataFrame:
    """Rows get the individual that the metadata gives their clip."""
    e = events(spark, d)
    known = e.select("clip_id").distinct().withColumn("individual_id", F.col("clip_id") % 10)
    return clips.with_individual(e, known).groupBy("individual_id").agg(F.count("*").alias("n"), F.sum("t").alias("places"))


@query("SELECT DISTINCT s_nationkey AS id, CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey ELSE 1 END AS context_window_sec, 0.1 AS max_samples, 100 AS n_estimators, CASE WHEN s_nationkey % 2 = 0 THEN 'wavelet' ELSE 'nathan2012' END AS feature_set FROM supplier")
def settings_of_run(spark: SparkSession, d: str) -> DataFrame:
    """Settings of runs over the defaults, with values from a table."""
    rows = []
    for (k,) in table(spark, d, "supplier").select("s_nationkey").distinct().collect():  # 25 at most
        got = config.with_defaults({"model": "wavelet_rf", "model_config": {"context_window_sec": k, "feature_set": "wavelet"} if k % 2 == 0 else None})["model_config"]
        rows.append((k, got["context_window_sec"], got["max_samples"], got["n_estimators"], got["feature_set"]))
    return spark.createDataFrame(rows, "id int, context_window_sec int, max_samples double, n_estimators int, feature_set string")


@query("SELECT c_nationkey AS individual_id, n_name, r_name, count(*) AS rows, round(avg(o_totalprice), 4) AS mean FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL")
def individual_groups(spark: SparkSession, d: str) -> DataFrame:
    """Rows of clips take their individual from the metadata's map, and individuals their names from small dimensions."""
    rows = clips.with_individual(table(spark, d, "orders").withColumnRenamed("o_custkey", "clip_id"), table(spark, d, "customer").select(F.col("c_custkey").alias("clip_id"), F.col("c_nationkey").alias("individual_id")))
    n, r = F.broadcast(table(spark, d, "nation")), F.broadcast(table(spark, d, "region"))  # 25 and 5 rows at every scale
    g = rows.groupBy("individual_id").agg(F.count("*").alias("rows"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    return g.join(n, F.col("individual_id") == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("individual_id", "n_name", "r_name", "rows", "mean")


@query(f"WITH {_MAP}, {_K} SELECT CASE label WHEN 1 THEN 'click' WHEN 2 THEN 'view' WHEN 3 THEN 'signup' ELSE 'purchase' END AS label_name, count(*) AS n FROM fm WHERE label <> 0 GROUP BY 1")
def label_names(spark: SparkSession, d: str) -> DataFrame:
    meta = config.Metadata("events", SR, ["value", "individual_id", "label"], ["unknown", "click", "view", "signup", "purchase"], [], {}, {})
    names = clips.label_table(spark, meta).withColumnRenamed("label_idx", "label")
    return fr.annotated(_mapped(spark, d)).join(F.broadcast(names), "label").groupBy("label_name").agg(F.count("*").alias("n"))


# -- basins of a raster

_CELLS = """p AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), s AS (SELECT min(x) AS x0, min(y) AS y0, (64 - 2 * 4) / greatest(max(x) - min(x), max(y) - min(y)) AS s FROM p),
 q AS (SELECT CAST(least(greatest(floor((x - x0) * s) + 4, 0), 63) AS BIGINT) AS row, CAST(least(greatest(floor((y - y0) * s) + 4, 0), 63) AS BIGINT) AS col, count(*) AS n FROM p, s GROUP BY ALL),
 c AS (SELECT row, col, n, n / (SELECT max(n) FROM q) AS density FROM q)"""
#: A blur with deviation 2.5 and so a reach of 10 cells; edges lie between cells.
_BLUR = _CELLS + """, w AS (SELECT k, exp(-0.5 * power(k / 2.5, 2)) / (SELECT sum(exp(-0.5 * power(j / 2.5, 2))) FROM range(-10, 11) g(j)) AS w FROM range(-10, 11) h(k)),
 m AS (SELECT i, CASE WHEN i + k < 0 THEN -1 - (i + k) WHEN i + k >= 64 THEN 127 - (i + k) ELSE i + k END AS j, w FROM range(64) g(i), w),
 d AS (SELECT m.i AS row, c.col, sum(w * density) AS v FROM m JOIN c ON c.row = m.j GROUP BY ALL),
 b AS (SELECT d.row, m.i AS col, round(sum(w * v), 12) AS value FROM m JOIN d ON d.col = m.j GROUP BY ALL HAVING round(sum(w * v), 12) > 0)"""
_BASIN = "WITH RECURSIVE " + _BLUR + """, up AS (SELECT a.row * 64 + a.col AS cell, any_value(a.value) AS value, arg_max(n.row * 64 + n.col, (n.value, -(n.row * 64 + n.col))) AS up FROM b a JOIN b n ON n.row BETWEEN a.row - 1 AND a.row + 1 AND n.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1),
 r AS (SELECT cell, value, up AS at FROM up UNION ALL SELECT r.cell, r.value, up.up FROM r JOIN up ON up.cell = r.at WHERE up.up <> r.at),
 t AS (SELECT r.cell, r.value, r.at AS peak FROM r JOIN up ON up.cell = r.at WHERE up.up = up.cell),
 z AS (SELECT cell, value, dense_rank() OVER (ORDER BY peak) - 1 AS basin FROM t)"""


def _cells(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "embeddings").select(*(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xy")))
    return fr.raster(p, 64, 4)


@query(f"WITH {_BLUR} SELECT row, col, round(value, 6) AS value FROM b")
def raster_blur(spark: SparkSession, d: str) -> DataFrame:
    return basins.blurred(_cells(spark, d), 64, 2.5, tile=24)


@query(_BASIN + " SELECT cell // 64 AS row, cell % 64 AS col, round(value, 6) AS value, basin FROM z")
def raster_basins(spark: SparkSession, d: str) -> DataFrame:
    """Each cell climbs to its peak; tiles smaller than the raster, so that paths cross them."""
    return basins.basins(_cells(spark, d), 64, 2.5, tile=24)


@query(_BASIN + " SELECT basin, count(*) AS cells, CAST(sum(n) AS BIGINT) AS points FROM c JOIN z ON z.cell = c.row * 64 + c.col GROUP BY 1")
def points_of_basins(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d).persist()
    return basins.basin_of(cells, basins.basins(cells, 64, 2.5)).groupBy("basin").agg(F.count("*").alias("cells"), F.sum("n").alias("points"))


@query()
def least_basins(spark: SparkSession, d: str) -> DataFrame:
    """Basins under the least blur that leaves at most 20 of them, as a map of an embedding is divided into clusters."""
    cells = _cells(spark, d).persist()
    return basins.basins(cells, 64, basins.least_blur(cells, 64, CLUSTERS))


# -- losses

#: Soft classes of the embeddings' rows: shares of three squared components.
_SOFT = "v AS (SELECT label AS clip_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, embedding FROM embeddings), sq AS (SELECT clip_id, t, power(CAST(embedding[1] AS DOUBLE), 2) + 0.001 AS a, power(CAST(embedding[2] AS DOUBLE), 2) + 0.001 AS b, power(CAST(embedding[3] AS DOUBLE), 2) + 0.001 AS c FROM v), o AS (SELECT clip_id, t, k, p FROM (SELECT clip_id, t, unnest([0, 1, 2]) AS k, unnest([a, b, c]) / (a + b + c) AS p FROM sq))"
_JOINT = _SOFT + ", g AS (SELECT x.k AS i, y.k AS j, sum(x.p * y.p) AS v FROM o x JOIN o y ON x.clip_id = y.clip_id AND abs(x.t - y.t) <= 2 GROUP BY ALL), n AS (SELECT g.i, g.j, (g.v + h.v) / 2 / (SELECT sum(v) FROM g) AS v FROM g JOIN g h ON g.i = h.j AND g.j = h.i), m AS (SELECT i, sum(v) AS m FROM n GROUP BY 1)"


def _soft(spark: SparkSession, d: str) -> DataFrame:
    v = fr.with_time(table(spark, d, "embeddings").select(F.col("label").alias("clip_id"), "vec_id", "embedding"), "clip_id", ["vec_id"])
    sq = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * x.cast("double") + 0.001)
    return v.withColumn("sq", sq).select("clip_id", "t", F.transform("sq", lambda x: x / (F.col("sq")[0] + F.col("sq")[1] + F.col("sq")[2])).alias("probs"))


@query(f"WITH {_JOINT} SELECT i, j, round(v, 6) AS value FROM n")
def joint_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of rows at most two apart, as one distribution."""
    return losses.joint(_soft(spark, d), 2)


@query(f"WITH {_JOINT} SELECT round(sum(-v * (ln(v) - 0.5 * ln(a.m) - 0.5 * ln(b.m))), 6) AS loss, round(sum(-v * (ln(v) - ln(a.m) - ln(b.m))), 6) AS loss_plain FROM n JOIN m a ON a.i = n.i JOIN m b ON b.i = n.j")
def information_loss(spark: SparkSession, d: str) -> DataFrame:
    return losses.information_loss(_soft(spark, d), 2, weight=0.5)


@query("WITH v AS (SELECT unnest(embedding[1:8]) AS x, unnest(range(8)) AS i, vec_id FROM embeddings) SELECT a.i, b.i AS j, round(sum(CAST(a.x AS DOUBLE) * CAST(b.x AS DOUBLE)) / (SELECT count(*) FROM embeddings), 6) AS value FROM v a JOIN v b USING (vec_id) GROUP BY ALL")
def latent_gram(spark: SparkSession, d: str) -> DataFrame:
    """Products of latent dimensions over all rows; eight components stand for latent vectors."""
    return losses.gram(table(spark, d, "embeddings").select(F.slice("embedding", 1, 8).alias("latent")))


@query()
def nuclear_loss(spark: SparkSession, d: str) -> DataFrame:
    """Five largest singular values of the whole embeddings' Gram matrix."""
    e = table(spark, d, "embeddings")
    return e.agg(F.count("*").alias("rows")).withColumn("loss", F.lit(losses.nuclear_loss(e, 5, 0.1, "embedding")))


@query("WITH v AS (SELECT unnest(embedding[1:32]) AS m, unnest(embedding[33:64]) AS s FROM embeddings) SELECT round(-0.5 * avg(1 + CAST(s AS DOUBLE) - power(CAST(m AS DOUBLE), 2) - exp(CAST(s AS DOUBLE))), 6) AS loss FROM v")
def divergence_loss(spark: SparkSession, d: str) -> DataFrame:
    return losses.divergence(table(spark, d, "embeddings").select(F.slice("embedding", 1, 32).alias("mu"), F.slice("embedding", 33, 32).alias("logvar")))


# -- what models are fed


def _settings(model: str, **own) -> dict:
    return config.with_defaults({"model": model, "model_config": own})


@query(f"WITH {_F}, n AS (SELECT *, row_number() OVER (ORDER BY {_PATH}, t) - 1 AS index FROM f WHERE fold > 1) SELECT 'gmm' AS model, count(*) AS n, sum(t) AS places, sum(clip_id) AS clips FROM n WHERE index % 3 = 0 UNION ALL SELECT 'kmeans', count(*), sum(t), sum(clip_id) FROM f WHERE fold > 1 AND t % 3 = 0 UNION ALL SELECT 'hmm', count(*), sum(t), sum(clip_id) FROM f WHERE fold > 1")
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that models without labels are fitted on where every third is asked for: of each clip, of all clips stacked, or all."""
    f = events(spark, d)
    f = fr.assign_split(f.drop("fold"), f.select("clip_id", "fold").distinct(), config.folds(5)).select("clip_id", "t", "split")
    out = None
    for name in ("gmm", "kmeans", "hmm"):
        r = runs.training_rows(f, _settings(name, downsample=3)).agg(F.lit(name).alias("model"), F.count("*").alias("n"), F.sum("t").alias("places"), F.sum("clip_id").alias("clips"))
        out = r if out is None else out.unionByName(r)
    return out


@query(f"WITH {_X}, s AS (SELECT clip_id, avg(sqrt(ax * ax + ay * ay + az * az)) + 1e-6 AS s FROM x GROUP BY 1), y AS (SELECT clip_id, t, ax / s AS ax FROM x JOIN s USING (clip_id)) SELECT clip_id, t, round(max(ax) OVER v, 6) AS high, round(avg(ax) OVER v, 6) AS mean FROM y WINDOW v AS (PARTITION BY clip_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)")
def normalized_features(spark: SparkSession, d: str) -> DataFrame:
    """A classic model's features where acceleration is scaled: the mean and maximum of the first axis."""
    from pyspark.ml.functions import vector_to_array

    from tidewake.operators.classic import Classic

    m = Classic("dt", ["AccX", "AccY", "AccZ"], KNOWN, SR, _settings("dt", context_window_sec=5, normalize=True)["model_config"], dynamic_only=True)
    v = m.vectors(triaxial(spark, d)).select("clip_id", "t", vector_to_array("features").alias("v"))
    return v.select("clip_id", "t", F.col("v")[4 * features.STATS.index("max")].alias("high"), F.col("v")[0].alias("mean"))


@query()
def model_minibatch_kmeans(spark: SparkSession, d: str) -> DataFrame:
    m = models.model("minibatch_kmeans", CLUSTERS, 0).fit(vectors(spark, d))
    return m.predict(vectors(spark, d)).select("clip_id", "t", "label", "pred")


# -- neighbours


def _spectra(spark: SparkSession, d: str) -> DataFrame:
    """Squared components stand for a row's spectrum."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), neighbours.shares(F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))).alias("v"))


@query()
def neighbour_graph(spark: SparkSession, d: str) -> DataFrame:
    """Nearest neighbours of each row under symmetric divergence, by descent (the test measures recall against brute force)."""
    return neighbours.neighbours(_spectra(spark, d), 16)


@query()
def fuzzy_graph(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.fuzzy(neighbours.neighbours(_spectra(spark, d), 16), 16)


@query()
def embedding_map(spark: SparkSession, d: str) -> DataFrame:
    """All rows on the plane, laid out from their fuzzy graph."""
    rows = lineage.cut(_spectra(spark, d))
    return embedding.layout(lineage.cut(neighbours.fuzzy(neighbours.neighbours(rows, 16), 16)), embedding.start(rows))


@query()
def model_umapper(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth row of each clip is fitted; all are predicted from every fourth, placed beside the fitted ones. The model's defaults."""
    v, own = vectors(spark, d), _settings("umapper")
    m = models.model("umapper", CLUSTERS, 0, **own["model_config"]).fit(runs.training_rows(v.withColumn("split", F.lit("train")), own))
    return m.predict(v).select("clip_id", "t", "label", "pred")


# -- sinks and what is read back from them


@query(f"WITH {_F} SELECT clip_id, count(*) AS n, CAST(sum(pred * t) AS BIGINT) AS total, sum(CASE WHEN label = pred THEN 1 ELSE 0 END) AS hits FROM f GROUP BY 1")
def stored_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions written by clip, read again and aligned with their rows."""
    e, path = events(spark, d), lineage.new_folder(spark, "predictions")
    clips.write_predictions(e, path)
    told = clips.align(e.drop("pred"), spark.read.parquet(path))
    return told.groupBy("clip_id").agg(F.count("*").alias("n"), F.sum(F.col("pred") * F.col("t")).alias("total"), F.sum((F.col("label") == F.col("pred")).cast("int")).alias("hits"))


@query(f"WITH {_EV}, {_K}, {_prf('fm', 'split,')}, e AS (SELECT 'labels' AS name, split, label, CAST(0 AS BIGINT) AS pred, tp + fn AS n FROM pr UNION ALL SELECT 'confusion', g.split, g.label, g.pred, coalesce(c.n, 0) FROM (SELECT DISTINCT split, a.label, b.label AS pred FROM fm, k a, k b) g LEFT JOIN (SELECT split, label, pred, count(*) AS n FROM fm WHERE label <> 0 GROUP BY ALL) c USING (split, label, pred)) SELECT * FROM e")
def stored_results(spark: SparkSession, d: str) -> DataFrame:
    """Tables of two evaluations written with their runs' keys; one of them read again."""
    path, tables = lineage.new_folder(spark, "results"), _evaluated(spark, d)
    kept = {k: tables[k] for k in ("labels", "confusion")}
    for fold in (0, 1):
        clips.write_results(kept if fold else {k: t.limit(1) for k, t in kept.items()}, path, experiment="toy", fold=fold)
    labels, confusion = (clips.read_results(spark, path, k, experiment="toy", fold=1) for k in kept)
    return labels.select(F.lit("labels").alias("name"), "split", "label", F.lit(0).cast("long").alias("pred"), F.col("truth").alias("n")).unionByName(confusion.select(F.lit("confusion").alias("name"), "split", "label", F.col("pred").cast("long").alias("pred"), "n"))
