"""A map of rows in the plane, laid out from their fuzzy graph of neighbours, and clusters as basins of the map's density.

Each round moves every row by the forces that the layout's loss puts on it on average. Attraction runs along the graph's edges: an exchange brings both ends' places to
an edge, and a row's pulls are summed before they are shuffled to it, so a row that very many others are near is summed in many tasks. Repulsion
by all other rows depends on a place alone: rows are counted on a grid of GRID x GRID cells, the driver convolves these counts (never more than GRID^2 numbers) with
the force's kernel, and each row reads the field at its place. So a round costs edges and rows, not pairs, and nothing is sampled. A move is the
force over the strength of a row's own springs, which needs no step size; moves have momentum. Where all forces balance, so do those of the
loss. Sums are made of whole numbers (millionths), so that the map doesn't depend on partitions.

New rows are placed by a search of the graph: they start from the rows next to them on random lines, and go on to neighbours of the nearest found so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions.lineage import cut, replaced, stored

from . import frames as fr
from .basins import basin_of, basins, least_blur
from .models import BehaviourModel
from .neighbours import fuzzy, lined, nearest, neighbours, shares, strengths, told

GRID = 256  # cells of the field's side
REPEL = 5.0  # repulsions for each attraction
NEAR = 1e-3  # squared distance added in repulsion
LIMIT = 4.0  # of a single force along an axis
WIDTH = 10.0  # largest coordinate of the start
UNIT = 1e6  # sums are of whole numbers of 1 / UNIT
PLACES = 6  # decimals of places


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^2b) that fits closeness best: 1 up to min_dist, and exp(-(d - min_dist) / spread) beyond it."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    p, damp = np.zeros(2), 1e-2  # logarithms of a and b

    def error(p: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(p[0]) * d ** (2 * np.exp(p[1]))) - want

    for _ in range(200):
        e, h = error(p), 1e-6
        j = np.stack([(error(p + h * u) - e) / h for u in np.eye(2)], 1)
        step = np.linalg.solve(j.T @ j + damp * np.eye(2), -j.T @ e)
        better = (error(p + step) ** 2).sum() < (e**2).sum()
        p, damp = (p + step, damp / 3) if better else (p, damp * 3)
        if np.abs(step).max() < 1e-10:
            break
    return float(np.exp(p[0])), float(np.exp(p[1]))


def start(rows: DataFrame) -> DataFrame:
    """id, x, y: rows (id, v) on the two main axes of the logarithms of their shares, so that the largest coordinate is WIDTH."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    logs = rows.select("id", array_to_vector(F.transform("v", lambda x: F.log(x))).alias("_l"))
    some = rows.select(F.size("v")).take(2)
    if len(some) < 2 or some[0][0] < 2:  # no plane
        return rows.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    axes = PCA(k=2, inputCol="_l", outputCol="_p").fit(logs)
    pc = axes.pc.toArray()
    sign = [1.0 if pc[np.abs(pc[:, k]).argmax(), k] > 0 else -1.0 for k in range(2)]
    at = axes.transform(logs).withColumn("_p", vector_to_array("_p")).select("id", *((F.col("_p")[k] * sign[k]).alias(c) for k, c in enumerate("xy")))
    m = at.agg(*(F.avg(c) for c in "xy"), F.max(F.greatest(*(F.abs(c) for c in "xy")))).first()
    m = [0.0 if v is None else v for v in m]
    top = at.agg(F.max(F.greatest(F.abs(F.col("x") - m[0]), F.abs(F.col("y") - m[1])))).first()[0] or 1.0
    return at.select("id", *(F.round((F.col(c) - m[k]) / top * WIDTH, PLACES).alias(c) for k, c in enumerate("xy")))


def field(at: DataFrame, a: float, b: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(force on each node of the grid, the first node's place, the distance of nodes): the mean repulsion by all rows of at (x, y).

    Rows count for the node nearest to them. At most GRID^2 counts come to the driver.
    """
    r = at.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.count("*")).first()
    low, n = np.array([r[0] or 0.0, r[1] or 0.0]), max(1, r[4])
    side = max((r[2] or 0.0) - low[0], (r[3] or 0.0) - low[1], 1e-6) / (GRID - 2)
    node = lambda c, k: F.least(F.greatest(F.round((F.col(c) - float(low[k])) / side), F.lit(0)), F.lit(GRID - 1)).cast("int")
    counts = np.zeros((GRID, GRID))
    t = at.groupBy(node("x", 0).alias("i"), node("y", 1).alias("j")).agg(F.count("*").alias("n")).toArrow()
    counts[t.column("i").to_numpy(), t.column("j").to_numpy()] = t.column("n").to_numpy()
    d = np.fft.fftfreq(2 * GRID, 1 / (2 * GRID)) * side
    far = d[:, None] ** 2 + d[None] ** 2
    k = 2 * b / ((NEAR + far) * (1 + a * far**b))
    waves = np.fft.rfft2(counts, (2 * GRID, 2 * GRID))
    force = [np.fft.irfft2(waves * np.fft.rfft2(np.clip(k * x, -LIMIT, LIMIT)), (2 * GRID, 2 * GRID))[:GRID, :GRID] / n for x in (d[:, None], d[None])]
    return np.stack(force, 2), low, float(side)


def read(grid: np.ndarray, low: np.ndarray, side: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The field at places, linear between nodes."""
    p = np.stack(((x - low[0]) / side, (y - low[1]) / side), 1).clip(0, GRID - 1.000001)
    i = p.astype(int)
    u, v = (p - i).T[:, :, None]
    i, j = i.T
    return (1 - u) * ((1 - v) * grid[i, j] + v * grid[i, j + 1]) + u * ((1 - v) * grid[i + 1, j] + v * grid[i + 1, j + 1])


def pulls(edges: DataFrame, at: DataFrame, a: float, b: float) -> DataFrame:
    """a, degree, springs, px, py: of each row with edges the sums of its weights, its springs' strengths, and its pulls."""
    one = edges.join(at.select(F.col("id").alias("b"), F.col("x").alias("_u"), F.col("y").alias("_v")), "b")
    two = one.join(at.select(F.col("id").alias("a"), F.col("x").alias("_x"), F.col("y").alias("_y")), "a")  # dealt by a, as the sums are
    dx, dy = F.col("_u") - F.col("_x"), F.col("_v") - F.col("_y")
    far = F.greatest(dx * dx + dy * dy, F.lit(NEAR))
    two = two.withColumn("_g", 2 * F.col("weight") * 2 * a * b * F.pow(far, F.lit(b - 1)) / (1 + a * F.pow(far, F.lit(b))))
    whole = lambda c: F.sum(F.round(c * UNIT).cast("long")) / UNIT
    return two.groupBy("a").agg(*(whole(c).alias(n) for n, c in (("degree", F.col("weight")), ("springs", F.col("_g")), ("px", F.col("_g") * dx), ("py", F.col("_g") * dy))))


def layout(graph: DataFrame, begin: DataFrame, min_dist: float = 0.1, rounds: int = 30, momentum: float = 0.7) -> DataFrame:
    """id, x, y of every row of begin (id, x, y) after `rounds` moves. graph: a, b, weight for each pair of neighbours once (see fuzzy()); rows without
    edges stay where they are, edges with an end that has no place count for nothing."""
    a, b = curve(min_dist)
    edges = graph.select("a", "b", "weight").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).persist()
    now = stored(begin.select("id", "x", "y", F.lit(0.0).alias("_vx"), F.lit(0.0).alias("_vy")))
    context = begin.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(field(now, a, b))  # its size is fixed

        def move(batches: Iterator[pd.DataFrame], shared: Any = shared) -> Iterator[pd.DataFrame]:
            for d in batches:
                push = REPEL * d["degree"].to_numpy()[:, None] * read(*shared.value, d["x"].to_numpy(), d["y"].to_numpy())
                force = (d[["px", "py"]].to_numpy() + push) / (1 + d["springs"].to_numpy()[:, None])
                v = momentum * d[["_vx", "_vy"]].to_numpy() + force.clip(-LIMIT, LIMIT)
                p = d[["x", "y"]].to_numpy() + v
                yield pd.DataFrame({"id": d["id"], "x": p[:, 0].round(PLACES), "y": p[:, 1].round(PLACES), "_vx": v[:, 0].round(PLACES), "_vy": v[:, 1].round(PLACES)})

        told_ = now.join(pulls(edges, now, a, b).withColumnRenamed("a", "id"), "id", "left").fillna(0.0, ["degree", "springs", "px", "py"])
        now = replaced(told_.mapInPandas(move, "id long, x double, y double, _vx double, _vy double"), now)
        shared.unpersist()
    edges.unpersist()
    return now.select("id", "x", "y")


def search(new: DataFrame, rows: DataFrame, graph: DataFrame, k: int, lines: int = 8, rounds: int = 6, seed: int = 0) -> DataFrame:
    """a, b, d: for each row a of new its k nearest rows b of rows, nearly, with their divergence d. Both: id, v; graph: a, b of the neighbours of rows.

    What is next to a row on a line is looked for in stretches of it, as neighbours() does, and each round looks at the neighbours of the k found.
    """
    new, rows = new.select("id", "v").persist(), rows.select("id", "v").persist()
    # ids of both get along: those of new become odd numbers
    every = new.select((2 * F.col("id") + 1).alias("id"), "v").unionByName(rows.select((2 * F.col("id")).alias("id"), "v"))
    met = lined(every, k, lines, seed, back=True).where("a % 2 <> 0 AND b % 2 = 0")
    first = met.select(F.expr("(a - 1) div 2").alias("a"), F.expr("b div 2").alias("b")).distinct()
    # a row whose line-mates are all new ones starts from the rows with the least ids
    some = rows.orderBy("id").limit(k).select(F.col("id").alias("b"))
    lost = new.select(F.col("id").alias("a")).join(first, "a", "left_anti").crossJoin(F.broadcast(some))
    now = stored(nearest(told(first.unionByName(lost), new, rows), k))
    edges = graph.select(F.col("a").alias("b"), F.col("b").alias("_to"))
    for _ in range(rounds):
        step = now.join(edges, "b").select("a", F.col("_to").alias("b")).distinct().join(now, ["a", "b"], "left_anti")
        after = stored(nearest(now.unionByName(told(step, new, rows)), k))
        ended = after.join(now, ["a", "b"], "left_anti").isEmpty()
        now = after
        if ended:
            break
    return now


def placed(found: DataFrame, at: DataFrame, k: int) -> DataFrame:
    """id, x, y: each row a of found (a, b, d) at the mean of its neighbours' places by their strengths; one that equals a neighbour is placed on it."""
    same = found.where("d <= 1e-12").groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b"))
    own = same.join(at.withColumnRenamed("id", "b"), "b").select("id", F.col("x").alias("_x"), F.col("y").alias("_y"))
    w = strengths(found, k).join(at.withColumnRenamed("id", "b"), "b")
    mean = w.groupBy(F.col("a").alias("id")).agg(*((F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in "xy"))
    return mean.join(own, "id", "left").select("id", *(F.round(F.coalesce(f"_{c}", c), PLACES).alias(c) for c in "xy"))


class Umapper(BehaviourModel):
    """Clusters of spectra: neighbours under symmetric divergence, their map in the plane, and the basins of the map's density, at most `clusters` of them.

    Features are made shares of their sum; negative ones count as their absolute value. Rows to predict are thinned by `downsample` in each clip, placed
    beside the fitted rows, and predictions are spread over all rows again.
    """

    def _shares(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        d = fr.numbered(rows.select("clip_id", "t", vector_to_array("features").alias("v")))
        return d.select(F.col("index").cast("long").alias("id"), "clip_id", "t", shares(F.transform("v", lambda x: F.abs(x))).alias("v"))

    def fit(self, rows: DataFrame) -> Umapper:
        s = self.settings
        self.rows = cut(self._shares(rows).select("id", "v"))
        k = max(1, min(s.get("n_neighbors", 16), self.rows.count() - 1))
        if self.rows.isEmpty():
            raise ValueError("no rows")
        self.graph = cut(neighbours(self.rows, k, seed=self.seed))
        self.at = layout(cut(fuzzy(self.graph, k)), start(self.rows), s.get("min_dist", 0.1), s.get("rounds", 30))
        self.frame = fr.raster_frame(self.at, self._size, self._border).first().asDict()
        cells = cut(self._cells(self.at).groupBy("row", "col").agg(F.count("*").alias("n")))
        top = cells.agg(F.max("n")).first()[0]
        cells = cells.select("row", "col", (F.col("n") / top).alias("density"))
        self.blur = least_blur(cells, self._size, self.clusters, s.get("n_watershed_trials", 10))
        self.basins = cut(basins(cells, self._size, self.blur))
        return self

    @property
    def _size(self) -> int:
        return self.settings.get("image_size", 2048)

    @property
    def _border(self) -> int:
        return self.settings.get("image_border", 48)

    def _cells(self, at: DataFrame) -> DataFrame:
        fitted = at.sparkSession.createDataFrame([self.frame], "_x double, _y double, _s double")
        return fr.raster_cells(at, fitted, self._size, self._border)

    def place(self, rows: DataFrame) -> DataFrame:
        """clip_id, t, x, y: rows on the map."""
        k = self.settings.get("n_neighbors", 16)
        new = cut(self._shares(rows))
        at = placed(search(new, self.rows, self.graph, k, seed=self.seed), self.at, k)
        return new.select("id", "clip_id", "t").join(at, "id").drop("id")

    def predict(self, rows: DataFrame) -> DataFrame:
        step = int(self.settings.get("downsample") or 1)
        found = basin_of(self._cells(self.place(fr.every_nth(rows, step))), self.basins)
        pred = fr.upsampled(rows, found.select("clip_id", "t", F.col("basin").cast("int").alias("pred")), step)
        return rows.join(pred, ["clip_id", "t"])

    def diagnostics(self, spark: SparkSession) -> dict[str, DataFrame]:
        """map: id, x, y of the fitted rows; basins: row, col, value, basin of the raster's cells."""
        return {"map": self.at, "basins": self.basins}

    def _state(self) -> dict[str, Any]:
        return {"frame": self.frame, "blur": self.blur}

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        super().save(path, spark)
        for name in ("rows", "graph", "at", "basins"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    def _restore(self, state: dict[str, Any], spark: SparkSession, path: str) -> None:
        self.frame, self.blur = state["frame"], state["blur"]
        for name in ("rows", "graph", "at", "basins"):
            setattr(self, name, spark.read.parquet(f"{path}/{name}"))
