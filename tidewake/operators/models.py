"""Models behind one contract: fit(rows) and predict(rows), where rows have clip_id, t, features (a vector) and, for supervised ones, label."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from tidewake.functions import lineage
from tidewake.plans import config

from .frames import class_weights
from .signal import Whitening


STARTS = 4  # fits of one model from different starts that run at the same time


class BehaviourModel:
    """A model's settings, its fit, and predict(), which adds an int column pred. save() writes all that load() needs."""

    name = ""

    def __init__(self, clusters: int, seed: int = 0, **settings: Any):
        self.clusters, self.seed, self.settings = clusters, seed, settings

    def fit(self, rows: DataFrame) -> BehaviourModel:
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def diagnostics(self, spark: SparkSession) -> dict[str, DataFrame]:
        """Tables on a fit, by name."""
        return {}

    def _state(self) -> dict[str, Any]:
        """What a fit found, but for Spark ML's own models, as lists and numbers."""
        return {}

    def _restore(self, state: dict[str, Any], spark: SparkSession, path: str) -> None:
        pass

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        """Write the settings and what was fitted below path, wherever Spark can write."""
        spark = spark or SparkSession.active()
        about = {"name": self.name, "clusters": self.clusters, "seed": self.seed, "settings": self.settings, "state": self._state()}
        write_about(spark, about, path)


def write_about(spark: SparkSession, about: dict[str, Any], path: str) -> None:
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def read_about(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(f"{path}/about").first()[0])


def load(path: str, spark: SparkSession | None = None) -> BehaviourModel:
    """The model that save() wrote."""
    spark = spark or SparkSession.active()
    about = read_about(spark, path)
    m = model(about["name"], about["clusters"], about["seed"], **about["settings"])
    m._restore(about["state"], spark, path)
    return m


class Random(BehaviourModel):
    """Uniform classes; a row keeps its class over reruns and partitionings."""

    def predict(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("pred", F.pmod(F.xxhash64(F.lit(self.seed), "clip_id", "t"), F.lit(self.clusters)).cast("int"))


class _Ml(BehaviourModel):
    column = "features"

    def predict(self, rows: DataFrame) -> DataFrame:
        drop = [c for c in ("rawPrediction", "probability", "_w") if c not in rows.columns]
        out = self.fitted.transform(self._prepare(rows))
        return out.withColumn("pred", F.col("prediction").cast("int")).drop("prediction", *drop)

    def _prepare(self, rows: DataFrame) -> DataFrame:
        return rows

    def _kind(self) -> type:
        """The class of what Spark ML fitted."""
        raise NotImplementedError

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        super().save(path, spark)
        self.fitted.write().overwrite().save(f"{path}/fitted")

    def _restore(self, state: dict[str, Any], spark: SparkSession, path: str) -> None:
        self.fitted = self._kind().load(f"{path}/fitted")


def _side_by_side(fit: Callable[[int], Any], n: int) -> list[Any]:
    """fit(0) to fit(n - 1), STARTS at a time, whose jobs share the cluster."""
    with ThreadPoolExecutor(STARTS) as pool:
        return list(pool.map(fit, range(n)))


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns of rows that a fit reads, dealt for many passes."""
    keys = [c for c in ("clip_id", "t") if c in rows.columns]
    return lineage.dealt(rows.select(*keys, *columns), *keys)


class KMeans(_Ml):
    """The best of n_init starts by cost, on whitened features if wanted."""

    white: Whitening | None = None

    def fit(self, rows: DataFrame) -> KMeans:
        from pyspark.ml.clustering import KMeans as Spark

        rows = _dealt(rows, "features")
        if self.settings.get("whiten"):
            self.white = Whitening(self.settings.get("n_components", "mle")).fit(rows)
            rows = lineage.cut(self.white.transform(rows).select("white"))
        one = lambda s: Spark(k=self.clusters, maxIter=self.settings.get("max_iter", 100), seed=self.seed + s, featuresCol="white" if self.white else "features").fit(rows)
        starts = _side_by_side(one, self.settings.get("n_init", 10))  # each keeps the vectors that it passes over
        self.fitted = min(starts, key=lambda m: m.summary.trainingCost)
        return self

    def _prepare(self, rows: DataFrame) -> DataFrame:
        return self.white.transform(rows) if self.white else rows

    def _kind(self) -> type:
        from pyspark.ml.clustering import KMeansModel

        return KMeansModel

    def _state(self) -> dict[str, Any]:
        return {"matrix": self.white.matrix.tolist()} if self.white else {}

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        super().save(path, spark)
        if self.white:
            self.white.scaler.write().overwrite().save(f"{path}/scaler")

    def _restore(self, state: dict[str, Any], spark: SparkSession, path: str) -> None:
        from pyspark.ml.feature import StandardScalerModel

        super()._restore(state, spark, path)
        if state:
            self.white = Whitening(self.settings.get("n_components", "mle"))
            self.white.matrix, self.white.scaler = np.array(state["matrix"]), StandardScalerModel.load(f"{path}/scaler")


class MiniBatchKMeans(BehaviourModel):
    """K-means by mini-batches: each step moves the centres towards the means of a batch's rows, at rates of one over the rows that a centre has had.

    Rows are dealt to batches of batch_size by a seeded hash of clip and t, a new deal each epoch, by one exchange; a step is a Spark job over the partitions of
    its batch alone (of PIECE rows, about), summed by the tasks, and the driver holds the centres alone. It stops when the smoothed inertia of batches (weight min(1, 2 / (batches + 1)) of the new one) has
    not been lowest for `patience` steps, or after max_iter epochs. Centres start by k-means++ over a sample of init_rows rows, as many for each centre as
    it takes at least 10. Ties go to the first centre; centres that get no rows stay where they are.
    """

    PIECE = 1 << 13  # rows of a batch that one task takes, about

    def fit(self, rows: DataFrame) -> MiniBatchKMeans:
        from pyspark.ml.functions import vector_to_array

        s, rng = self.settings, np.random.default_rng(self.seed)
        x = rows.select("clip_id", "t", vector_to_array("features").alias("x")).persist()
        n = x.count()
        if not n:
            x.unpersist()
            raise ValueError("no rows")
        batches = max(1, round(n / s.get("batch_size", 1024)))
        pieces = max(1, -(-n // (batches * self.PIECE)))
        h = F.xxhash64(F.lit(self.seed), "clip_id", "t")
        least = max(10 * self.clusters, s.get("init_rows", 3072))
        some = np.array([r[0] for r in x.orderBy(h, "clip_id", "t").limit(least).select("x").collect()])  # a bounded sample
        self.centres, seen = self._spread(some, rng), np.zeros(self.clusters)
        alpha, smooth, lowest, idle = min(1.0, 2.0 / (batches + 1)), None, math.inf, 0
        self.inertias: list[tuple[float, float]] = []
        for epoch in range(s.get("max_iter", 100)):
            dealt = self._dealt(x, epoch, batches, pieces)
            for b in range(batches):
                sums, count, inertia = self._step(dealt, range(b * pieces, (b + 1) * pieces))
                if not count.sum():
                    continue
                seen += count
                use = count > 0
                self.centres[use] += (sums[use] - count[use, None] * self.centres[use]) / seen[use, None]
                value = inertia / count.sum()
                smooth = value if smooth is None else smooth * (1 - alpha) + value * alpha
                self.inertias.append((value, smooth))
                idle = 0 if smooth < lowest else idle + 1
                lowest = min(lowest, smooth)
                if idle >= s.get("patience", 100):
                    x.unpersist()
                    return self
        x.unpersist()
        return self

    def _spread(self, some: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """k-means++: each centre a row, the next one at odds of its squared distance to the nearest."""
        centres = [some[rng.integers(len(some))]]
        far = ((some - centres[0]) ** 2).sum(1)
        while len(centres) < self.clusters:
            k = rng.choice(len(some), p=far / far.sum()) if far.sum() > 0 else rng.integers(len(some))
            centres.append(some[k])
            far = np.minimum(far, ((some - some[k]) ** 2).sum(1))
        return np.array(centres, float)

    def _dealt(self, x: DataFrame, epoch: int, batches: int, pieces: int) -> RDD:
        """The rows of batch b in the partitions from b * pieces on, packed; each partition's rows in order of clip and t."""
        h = F.xxhash64(F.lit(self.seed + epoch + 1), "clip_id", "t")
        place = F.pmod(h, F.lit(batches)) * pieces + F.pmod(F.shiftright(h, 32), F.lit(pieces))
        rows = x.withColumn("_p", place.cast("int")).repartitionById(batches * pieces, F.col("_p")).sortWithinPartitions("clip_id", "t")

        def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32()), pa.array([b.column("x").flatten().to_numpy().tobytes()])], ["n", "v"])

        return rows.select("x").mapInArrow(pack, "n int, v binary").rdd

    def _step(self, dealt: RDD, batch: range) -> tuple[np.ndarray, np.ndarray, float]:
        """Sums and numbers of the batch's rows nearest to each centre, and the sum of their squared distances."""
        centres, k = self.centres, self.clusters

        def run(packed: Iterator[Any]) -> Iterator[np.ndarray]:
            total = np.zeros((k, centres.shape[1] + 2))
            for r in packed:
                x = np.frombuffer(r["v"]).reshape(r["n"], -1)
                near, d = _nearest(x, centres)
                np.add.at(total, near, np.column_stack((x, np.ones(len(x)), d)))
            yield total

        out = sum(dealt.context.runJob(dealt, run, list(batch)))  # centres x dimensions a task
        return out[:, :-2], out[:, -2], float(out[:, -1].sum())

    def predict(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        centres = self.centres

        @F.pandas_udf("int")
        def near(x: pd.Series) -> pd.Series:
            return pd.Series(_nearest(np.stack(x.to_list()), centres)[0].astype(np.int32) if len(x) else np.zeros(0, np.int32))

        return rows.withColumn("pred", near(vector_to_array("features")))

    def diagnostics(self, spark: SparkSession) -> dict[str, DataFrame]:
        """inertia: step, inertia (a batch's mean squared distance), smoothed."""
        return {"inertia": spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(self.inertias)], "step int, inertia double, smoothed double")}

    def _state(self) -> dict[str, Any]:
        return {"centres": self.centres.tolist()}

    def _restore(self, state: dict[str, Any], spark: SparkSession, path: str) -> None:
        self.centres, self.inertias = np.array(state["centres"]), []


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, the first of equal ones, and its squared distance."""
    d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0)
    near = d.argmin(1)
    return near, d[np.arange(len(x)), near]


class Gmm(_Ml):
    """The best of n_init starts by likelihood."""

    def fit(self, rows: DataFrame) -> Gmm:
        from pyspark.ml.clustering import GaussianMixture

        rows = _dealt(rows, "features")
        starts = _side_by_side(lambda s: GaussianMixture(k=self.clusters, maxIter=self.settings.get("max_iter", 100), seed=self.seed + s).fit(rows), self.settings.get("n_init", 1))
        self.fitted = max(starts, key=lambda m: m.summary.logLikelihood)
        return self

    def _kind(self) -> type:
        from pyspark.ml.clustering import GaussianMixtureModel

        return GaussianMixtureModel


class _Supervised(_Ml):
    """Fits on rows weighted so that classes count alike; labels are class indexes with unknown 0."""

    def _estimator(self):
        raise NotImplementedError

    def _weighted(self, rows: DataFrame) -> DataFrame:
        rows = _dealt(rows, "label", "features")
        w = class_weights(rows).select("label", F.col("balanced_weight").alias("_w"))
        return rows.join(F.broadcast(w), "label").withColumn("label", F.col("label") - 1)  # a row a label; classes from 0

    def fit(self, rows: DataFrame) -> _Supervised:
        self.fitted = self._estimator().fit(self._weighted(rows))
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return super().predict(rows).withColumn("pred", F.col("pred") + 1)


def _least_rows(settings: dict[str, Any]) -> int:
    """Rows of a child, at least: half of what a node must have to be split, as Spark sets a bound on children only."""
    return max(1, -(-int(settings.get("min_samples_split", 2)) // 2))


#: How trees are grown: each row keeps the nodes that it is in, so a pass ships no trees, which grow with the rows; a pass takes as many nodes as their statistics fill this memory of a task (MB).
GROW = {"cacheNodeIds": True, "maxMemoryInMB": 512}


#: Nodes of trees that the driver holds at a time, about; a node takes up to a kilobyte while it is fitted.
NODES = 1 << 18


class Forest(_Supervised):
    """Trees that together may have over NODES nodes (twice the rows that they are fitted on; after the first ones, a quarter more than those have) are fitted group by group. A group is written to
    the shared folder and leaves the driver; rows to predict pass the groups in turn, and votes of all trees are summed, as one forest does. One tree is held whole."""

    groups: list[str] = []

    def _estimator(self, trees: int | None = None, seed: int | None = None):
        from pyspark.ml.classification import RandomForestClassifier

        s = self.settings
        trees, seed = s.get("n_estimators", 100) if trees is None else trees, self.seed if seed is None else seed
        return RandomForestClassifier(numTrees=trees, subsamplingRate=s.get("max_samples", 0.1), maxDepth=s.get("max_depth", 30), minInstancesPerNode=_least_rows(s), weightCol="_w", seed=seed, **GROW)

    def _kind(self) -> type:
        from pyspark.ml.classification import RandomForestClassificationModel

        return RandomForestClassificationModel

    def fit(self, rows: DataFrame) -> Forest:
        rows, left = self._weighted(rows), self.settings.get("n_estimators", 100)
        most = min(2.0 * rows.count() * self.settings.get("max_samples", 0.1), 2.0 ** (self.settings.get("max_depth", 30) + 1))  # nodes of a tree
        self.groups = []
        if left * most <= NODES:
            self.fitted = self._estimator().fit(rows)
            return self
        folder, self.fitted = lineage.new_folder(rows.sparkSession, "forest"), None
        while left:
            n = min(left, max(1, int(NODES / most)))
            fitted = self._estimator(n, self.seed + len(self.groups)).fit(rows)
            most = max(1.0, 1.25 * fitted.totalNumNodes / n)
            self.groups.append(f"{folder}/{len(self.groups)}")
            fitted.write().save(self.groups[-1])
            left -= n
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        if not self.groups:
            return super().predict(rows)
        from pyspark.ml.functions import vector_to_array

        now, before = rows.withColumn("_votes", F.lit(None).cast("array<double>")), []
        for path in self.groups:
            own = self._kind().load(path).setPredictionCol("").setProbabilityCol("").setRawPredictionCol("_raw")
            votes = vector_to_array("_raw")
            told = own.transform(now).withColumn("_votes", F.when(F.col("_votes").isNull(), votes).otherwise(F.zip_with("_votes", votes, lambda x, y: x + y))).drop("_raw")
            now = lineage.replaced(told, *before)
            before = [now]
        return now.withColumn("pred", F.array_position("_votes", F.array_max("_votes")).cast("int")).drop("_votes")

    def _state(self) -> dict[str, Any]:
        return {"groups": len(self.groups)}

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        if not self.groups:
            return super().save(path, spark)
        BehaviourModel.save(self, path, spark)
        for k, group in enumerate(self.groups):
            self._kind().load(group).write().overwrite().save(f"{path}/fitted-{k}")

    def _restore(self, state: dict[str, Any], spark: SparkSession, path: str) -> None:
        self.groups = [f"{path}/fitted-{k}" for k in range(state.get("groups", 0))]
        if not self.groups:
            super()._restore(state, spark, path)


class Tree(_Supervised):
    def _estimator(self):
        from pyspark.ml.classification import DecisionTreeClassifier

        return DecisionTreeClassifier(maxDepth=self.settings.get("max_depth", 30), minInstancesPerNode=_least_rows(self.settings), weightCol="_w", seed=self.seed, **GROW)

    def _kind(self) -> type:
        from pyspark.ml.classification import DecisionTreeClassificationModel

        return DecisionTreeClassificationModel


class Svm(_Supervised):
    """One linear machine a class; its loss is the plain hinge. regularization_parameter weighs the sum of losses against half the squared weights,
    so Spark's regParam, which weighs the latter against the mean loss, is one over it and the rows."""

    def fit(self, rows: DataFrame) -> Svm:
        rows = _dealt(rows, "label", "features")
        self.rows = max(1, rows.count())
        return super().fit(rows)

    def _estimator(self):
        from pyspark.ml.classification import LinearSVC, OneVsRest

        return OneVsRest(classifier=LinearSVC(maxIter=self.settings.get("max_iter", 1000), regParam=1.0 / (self.settings.get("regularization_parameter", 1.0) * self.rows)), weightCol="_w", parallelism=STARTS)

    def _kind(self) -> type:
        from pyspark.ml.classification import OneVsRestModel

        return OneVsRestModel


def _log_normal(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Log densities of rows under each state. var: variances (states x features), or whole covariances (states x features x features)."""
    d = x[:, None, :] - mean[None]
    if var.ndim == 2:
        return -0.5 * ((d * d / var[None]).sum(2) + np.log(2 * math.pi * var).sum(1)[None])
    return -0.5 * (np.einsum("nki,kij,nkj->nk", d, np.linalg.inv(var), d) + np.linalg.slogdet(2 * math.pi * var)[1][None])


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def viterbi(x: np.ndarray, start: np.ndarray, move: np.ndarray, mean: np.ndarray, var: np.ndarray, end: int | None = None) -> np.ndarray:
    """The likeliest states, of those that end in state `end` if one is given. start, move: log probabilities."""
    emit = _log_normal(x, mean, var)
    back = np.zeros((len(x), len(start)), np.int32)
    now = start + emit[0]
    for t in range(1, len(x)):
        s = now[:, None] + move
        back[t] = s.argmax(0)
        now = s.max(0) + emit[t]
    out = np.empty(len(x), np.int64)
    out[-1] = now.argmax() if end is None else end
    for t in range(len(x) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def transfer(x: np.ndarray, move: np.ndarray, mean: np.ndarray, var: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Of the best paths through rows x, the log probability from each state before the first row (or from the first states of a clip, one row) to each
    state of the last one. Products of such matrices, with maxima for sums, are those of the joined rows."""
    emit = _log_normal(x, mean, var)
    now = (move if start is None else start[None]) + emit[0]
    for t in range(1, len(x)):
        now = (now[:, :, None] + move[None]).max(1) + emit[t]
    return now


def borders(parts: list[np.ndarray]) -> list[tuple[int, int]]:
    """Of each part of a clip (its transfer matrices in order), the state before it and its last state on the best path; before the first one, -1."""
    best, back = parts[0][0], []
    for m in parts[1:]:
        s = best[:, None] + m
        back.append(s.argmax(0))
        best = s.max(0)
    ends = [int(best.argmax())]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    ends.reverse()
    return list(zip([-1, *ends[:-1]], ends, strict=True))


class Hmm(BehaviourModel):
    """A Gaussian hidden Markov model, of diagonal or full covariance: expectations by chunks of temporal_window_samples rows in Spark tasks, summed there,
    maximisation on the driver. Chunks are made once, a row each; a task takes many side by side and sends one row of sums an iteration.

    Whole chunks of a clip's rows train (a rest is dropped); features are scaled by the mean and deviation of these rows, a constant one is only
    centred. Starts from k-means. What is maximised has a Dirichlet prior on the first states and on each row of moves, and a normal-inverse-gamma (or
    Wishart) one on emissions. All N_iters iterations are made; likelihood has a value for each.

    Prediction is the best path over a whole clip, found in parts of PART rows: each part gives the best scores from any state before it to any
    state at its end, a clip's parts are chained over these matrices, and each part then finds its path between its border states.
    """

    FIRST = 1.1  # fixed value: the concentration of first states
    PART = 1 << 15  # rows of a clip that one task decodes
    SIDE = 1 << 13  # rows whose chunks a task takes at once

    def fit(self, rows: DataFrame) -> Hmm:
        from pyspark.ml.functions import array_to_vector, vector_to_array
        from pyspark.ml.stat import Summarizer

        s, k = self.settings, self.clusters
        w, full = s.get("temporal_window_samples", 2500), s.get("covariance", "diagonal") == "full"
        place = F.row_number().over(Window.partitionBy("clip_id").orderBy("t")) - 1
        whole = F.count("*").over(Window.partitionBy("clip_id"))
        rows = rows.withColumns({"_place": place, "_rows": whole}).where(F.col("_place") < F.col("_rows") - F.col("_rows") % w)
        rows = rows.select("clip_id", F.floor(F.col("_place") / w).alias("chunk"), "t", "features").persist()
        n = rows.count()
        if not n:
            rows.unpersist()
            raise ValueError("no clip has a whole chunk")
        told = rows.select(Summarizer.metrics("mean", "variance").summary(F.col("features")).alias("s")).first()["s"]
        self.centre, spread = told["mean"].toArray(), np.sqrt(told["variance"].toArray() * (n - 1) / n)
        self.scale = np.where(spread > 0, spread, 1.0)
        scaled = F.zip_with(vector_to_array("features"), F.array(*(F.struct(F.lit(float(m)).alias("m"), F.lit(float(d)).alias("d")) for m, d in zip(self.centre, self.scale, strict=True))), lambda x, y: (x - y["m"]) / y["d"])
        rows_kept, rows = rows, rows.withColumn("features", array_to_vector(scaled))
        start = KMeans(k, self.seed, n_init=1, max_iter=20).fit(rows)
        mean = np.array(start.fitted.clusterCenters())
        spread = np.maximum(rows.select(Summarizer.variance(F.col("features")).alias("v")).first()["v"].toArray(), 1e-3)
        self.mean, self.var = mean, np.tile(np.diag(spread), (k, 1, 1)) if full else np.tile(spread, (k, 1))
        self.start, self.move = np.full(k, -math.log(k)), np.log(np.full((k, k), 0.1 / k) + 0.9 * np.eye(k))
        self.likelihood: list[float] = []
        d = mean.shape[1]
        cuts = np.cumsum([1, k, k * k, k, k * d])
        x = rows.select("clip_id", "chunk", F.struct("t", vector_to_array("features").alias("x")).alias("r"))
        chunks = x.groupBy("clip_id", "chunk").agg(F.array_sort(F.collect_list("r")).alias("r"))  # w rows each
        chunks = chunks.select(F.flatten("r.x").alias("x")).persist()
        chunks.count()
        rows_kept.unpersist()
        for _ in range(s.get("N_iters", 50)):
            parts = chunks.mapInArrow(self._expect(w, d), "part array<double>").select(array_to_vector("part").alias("part"))
            total = parts.agg(Summarizer.sum(F.col("part")).alias("part")).first()["part"].toArray()  # summed by the tasks
            if np.isnan(total).any():
                raise ValueError("the likelihood is not a number")
            like, a, b, g, gx, gxx = np.split(total, cuts)
            b, gx = b.reshape(k, k), gx.reshape(k, d)
            self.likelihood.append(float(like[0]))
            p = np.maximum(a + self.FIRST - 1, 1e-10)
            self.start = np.log(p / p.sum())
            q = np.maximum(b + s.get("matrix_concentration", 1.1) - 1, 1e-10)
            self.move = np.log(q / q.sum(1, keepdims=True))
            c, scale = s.get("mean_concentration", 0.1), s.get("cov_scale", 0.1)
            self.mean = gx / np.maximum(g + c, 1e-10)[:, None]
            if full:  # the mode of the inverse Wishart: scatter about the mean, with the prior's scale
                scatter = gxx.reshape(k, d, d) - (g + c)[:, None, None] * np.einsum("ki,kj->kij", self.mean, self.mean) + scale * np.eye(d)
                self.var = scatter / (g + s.get("cov_df", 0.1) + 2 * d + 2)[:, None, None] + 1e-6 * np.eye(d)
            else:  # of the inverse gamma
                scatter = gxx.reshape(k, d) - (g + c)[:, None] * self.mean**2
                self.var = np.maximum((scale + scatter / 2) / (s.get("cov_concentration", 0.1) + g / 2 + 1.5)[:, None], 1e-6)
        chunks.unpersist()
        return self

    def _expect(self, w: int, d: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """The sums of a task's chunks (x: w rows of d features each), about SIDE rows at once: the recursions go over places, all chunks side by side."""
        start, move, mean, var, side = self.start, self.move, self.mean, self.var, max(1, self.SIDE // w)
        square = "nk,ni,nj->kij" if var.ndim == 3 else "nk,ni,ni->ki"

        def sums(x: np.ndarray) -> np.ndarray:
            flat, k = x.reshape(-1, d), len(start)
            emit = _log_normal(flat, mean, var).reshape(len(x), w, k)
            fwd, bwd = np.empty(emit.shape), np.zeros(emit.shape)
            fwd[:, 0] = start + emit[:, 0]
            for t in range(1, w):
                fwd[:, t] = _logsum(fwd[:, t - 1, :, None] + move, 1) + emit[:, t]
            for t in range(w - 2, -1, -1):
                bwd[:, t] = _logsum(move + (emit[:, t + 1] + bwd[:, t + 1])[:, None], 2)
            like = _logsum(fwd[:, -1], 1)
            gamma = np.exp(fwd + bwd - like[:, None, None])
            pair = np.zeros((k, k))
            for t in range(w - 1):
                pair += np.exp(fwd[:, t, :, None] + move + (emit[:, t + 1] + bwd[:, t + 1])[:, None] - like[:, None, None]).sum(0)
            first, gamma = gamma[:, 0].sum(0), gamma.reshape(-1, k)
            return np.concatenate(([like.sum()], first, pair.ravel(), gamma.sum(0), (gamma.T @ flat).ravel(), np.einsum(square, gamma, flat, flat).ravel()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for k in range(0, batch.num_rows, side):
                    found = sums(batch.column("x").slice(k, side).flatten().to_numpy().reshape(-1, w, d))
                    total = found if total is None else total + found
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["part"])

        return run

    def predict(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        start, move, mean, var, centre, scale, size = self.start, self.move, self.mean, self.var, self.centre, self.scale, self.PART
        of = lambda pdf: (np.stack(pdf["x"].to_list()) - centre) / scale
        clip, t = rows.schema["clip_id"], rows.schema["t"]
        long = LongType()

        def matrix(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            m = transfer(of(pdf.sort_values("t")), move, mean, var, None if key[1] else start)
            return pd.DataFrame({"clip_id": [key[0]], "part": [key[1]], "m": [m.ravel().tolist()]})

        def chain(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("part")
            found = borders([np.array(m).reshape(-1, len(start)) for m in pdf["m"]])
            return pdf[["clip_id", "part"]].assign(before=[x for x, _ in found], end=[y for _, y in found])

        def path(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("t")
            before, end = int(pdf["before"].iloc[0]), int(pdf["end"].iloc[0])
            return pdf[["clip_id", "t"]].assign(pred=viterbi(of(pdf), start if before < 0 else move[before], move, mean, var, end).astype(np.int32))

        # parts by place, not by t: rows may be every n-th of a clip
        place = F.row_number().over(Window.partitionBy("clip_id").orderBy("t")) - 1
        x = rows.select("clip_id", "t", vector_to_array("features").alias("x"), F.floor(place / size).alias("part"))
        parts = x.groupBy("clip_id", "part").applyInPandas(matrix, StructType([clip, StructField("part", long), StructField("m", ArrayType(DoubleType()))]))
        ends = parts.groupBy("clip_id").applyInPandas(chain, StructType([clip, StructField("part", long), StructField("before", long), StructField("end", long)]))
        pred = x.join(ends, ["clip_id", "part"]).groupBy("clip_id", "part").applyInPandas(path, StructType([clip, t, StructField("pred", IntegerType())]))
        return rows.join(pred, ["clip_id", "t"])

    def diagnostics(self, spark: SparkSession) -> dict[str, DataFrame]:
        """likelihood: iteration, log_probability (of the posterior's likelihood part); transitions: state, next, probability."""
        p = np.exp(self.move)
        return {
            "likelihood": spark.createDataFrame([(k, x) for k, x in enumerate(self.likelihood)], "iteration int, log_probability double"),
            "transitions": spark.createDataFrame([(i, j, float(p[i, j])) for i in range(len(p)) for j in range(len(p))], "state int, next int, probability double"),
        }

    def _state(self) -> dict[str, Any]:
        return {x: getattr(self, x).tolist() for x in ("start", "move", "mean", "var", "centre", "scale")} | {"likelihood": self.likelihood}

    def _restore(self, state: dict[str, Any], spark: SparkSession, path: str) -> None:
        for x, v in state.items():
            setattr(self, x, v if x == "likelihood" else np.array(v))


def _absent(name: str, needs: str) -> Callable[..., BehaviourModel]:
    def make(*_: Any, **__: Any) -> BehaviourModel:
        raise NotImplementedError(f"{name} needs {needs}, which is not part of this engine; evaluate its predictions as a table instead")

    return make


def _umapper(*a: Any, **settings: Any) -> BehaviourModel:
    from .embedding import Umapper

    return Umapper(*a, **settings)


#: Names to models; the deep ones are named, but need libraries beyond Spark.
MODELS: dict[str, Callable[..., BehaviourModel]] = {"random": Random, "kmeans": KMeans, "minibatch_kmeans": MiniBatchKMeans, "gmm": Gmm, "hmm": Hmm, "rf": Forest, "dt": Tree, "svm": Svm} | {n: _absent(n, "torch") for n in ("CRNN", "harnet", "vame", "iic")} | {"umapper": _umapper}


def model(name: str, clusters: int, seed: int = 0, **settings: Any) -> BehaviourModel:
    if name not in MODELS:
        raise ValueError(f"unknown model: {name}")
    made = MODELS[name](clusters, seed, **settings)
    made.name = name
    return made


def register(name: str, make: Callable[..., BehaviourModel], defaults: dict[str, Any] | None = None, grid: Callable[[str], dict[str, list[Any]]] | None = None, labels: bool = True) -> None:
    """Add a model of one's own: how it is made, its settings' defaults, the values that a sweep tries for a dataset, and whether its fit needs labels."""
    MODELS[name] = make
    config.extend(name, defaults or {}, grid, labels)
