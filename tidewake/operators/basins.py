"""Basins of a density on a raster: Gaussian blur, watershed by steepest ascent, and a search for the least blur with few enough basins.

The raster is cut into square tiles. A cell with points goes to each tile that its blur reaches (a halo), mirrored where it lies near the raster's edge, so
one exchange serves the blur of both axes. A tile blurs itself and a ring of one cell, so it knows the highest neighbour of each of its
cells, and follows these pointers as far as they stay inside. What is left are pointers from the tiles' borders to
cells of other tiles, a small table, whose paths are halved by joining it with itself until all end on a peak.

All tiles add in the same order, so a cell has the same value in each; values are rounded to 12 places so that ties don't depend on how sums are
written. Of equal neighbours the first by row and column is the higher one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions.lineage import cut

TILE = 256  # cells of a tile's side
REACH = 4.0  # deviations at which the blur is cut off (fixed value)
LEAST = 2.0**-6  # the search for a blur goes no lower


def kernel(sigma: float) -> np.ndarray:
    """Weights of the blur; they sum to 1."""
    r = int(REACH * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return w / w.sum()


def _images(p: Column, size: int, reach: int) -> Column:
    """The places at which a cell appears, mirrored at both edges (the edge lies between cells), as far as reach cells outside."""
    turns = range(-(reach // (2 * size) + 1), reach // (2 * size) + 2)
    every = F.array(*(x for k in turns for x in (p + 2 * size * k, F.lit(2 * size * k - 1) - p)))
    return F.filter(every, lambda x: (x >= -reach) & (x < size + reach))


def _tiles(place: Column, size: int, tile: int, reach: int) -> Column:
    last = (size - 1) // tile
    return F.sequence(F.greatest(F.floor((place - reach) / tile), F.lit(0)).cast("int"), F.least(F.floor((place + reach) / tile), F.lit(last)).cast("int"))


def _dealt(cells: DataFrame, size: int, tile: int, reach: int, value: str) -> DataFrame:
    """ti, tj, row, col, v: each cell and its mirror images for each tile within reach."""
    d = cells.select(F.col("row").cast("int"), F.col("col").cast("int"), F.col(value).cast("double").alias("v")).where("v <> 0")
    for c, t in (("row", "ti"), ("col", "tj")):
        d = d.withColumn(c, F.explode(_images(F.col(c), size, reach)))
        d = d.withColumn(t, F.explode(_tiles(F.col(c), size, tile, reach)))
    return d


def _spread(x: np.ndarray, w: np.ndarray, side: int) -> np.ndarray:
    """The sums over k of w[k] x[k : k + side], added in order of k. Rows and columns of zeros, most of a map of few points, are passed over."""
    rows, cols = np.flatnonzero(x.any(1)), np.flatnonzero(x.any(0))
    out = np.zeros((side, len(cols)))
    if len(rows) < len(w):
        turned = w[::-1]
        for r in rows:  # row r is reached from r - len(w) + 1 to r
            low, high = max(0, r - len(w) + 1), min(side, r + 1)
            out[low:high] += turned[low - r + len(w) - 1 : high - r + len(w) - 1, None] * x[r, cols]
    else:
        some = x[:, cols]
        for k in range(len(w)):
            out += w[k] * some[k : k + side]
    whole = np.zeros((side, x.shape[1]))
    whole[:, cols] = out
    return whole


def _blur(t: pa.Table, i: int, j: int, size: int, tile: int, w: np.ndarray, ring: int) -> np.ndarray:
    """The blurred values of tile (i, j) and a ring of cells about it; minus infinity outside the raster."""
    r, side = len(w) // 2, tile + 2 * ring
    dense = np.zeros((side + 2 * r, side + 2 * r))
    row, col = t.column("row").to_numpy() - i * tile + ring + r, t.column("col").to_numpy() - j * tile + ring + r
    inside = (row >= 0) & (row < len(dense)) & (col >= 0) & (col < len(dense))
    np.add.at(dense, (row[inside], col[inside]), t.column("v").to_numpy()[inside])
    out = np.round(_spread(_spread(dense, w, side).T, w, side).T, 12)
    rows, cols = (np.arange(side) - ring + k * tile for k in (i, j))
    out[(rows < 0) | (rows >= size)] = -np.inf
    out[:, (cols < 0) | (cols >= size)] = -np.inf
    return out


def _per_tile(cells: DataFrame, size: int, sigma: float, tile: int, value: str, ring: int, make: Callable[[int, int, np.ndarray], pa.Table], schema: str) -> DataFrame:
    w = kernel(sigma)

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        i, j = key[0].as_py(), key[1].as_py()
        return make(i, j, _blur(t, i, j, size, tile, w, ring))

    return _dealt(cells, size, tile, len(w) // 2 + ring, value).groupBy("ti", "tj").applyInArrow(run, schema)


def blurred(cells: DataFrame, size: int, sigma: float, value: str = "density", tile: int = TILE) -> DataFrame:
    """row, col, value of the cells of a size x size raster above 0 after a Gaussian blur. cells: row, col and value, a row a cell; absent ones are 0."""

    def make(i: int, j: int, v: np.ndarray) -> pa.Table:
        row, col = np.nonzero(v > 0)
        return pa.table({"row": pa.array(row + i * tile, pa.int32()), "col": pa.array(col + j * tile, pa.int32()), "value": pa.array(v[row, col])})

    return _per_tile(cells, size, sigma, tile, value, 0, make, "row int, col int, value double")


def _climb(v: np.ndarray) -> np.ndarray:
    """Of each inner cell of v, the flat place in v of the highest of it and its eight neighbours; the first one, if several are."""
    side = v.shape[1]
    best = np.full((v.shape[0] - 2, side - 2), -np.inf)
    at = np.zeros(best.shape, np.int64)
    place = np.arange(v.size).reshape(v.shape)
    for a in range(3):
        for b in range(3):
            x = v[a : a + best.shape[0], b : b + best.shape[1]]
            up = x > best
            best[up], at[up] = x[up], place[a : a + best.shape[0], b : b + best.shape[1]][up]
    return at


def _pointers(cells: DataFrame, size: int, sigma: float, tile: int, value: str) -> DataFrame:
    """cell, value, to: of each cell above 0 (row * size + col), where its ascent ends inside its tile, on a peak (itself) or in another tile."""

    def make(i: int, j: int, v: np.ndarray) -> pa.Table:
        side = v.shape[1]
        to = np.arange(v.size)
        inner = np.zeros(v.shape, bool)
        inner[1:-1, 1:-1] = True
        to[inner.ravel()] = _climb(v).ravel()
        while True:  # paths inside the tile are halved until they end; ring cells point to themselves
            new = to[to]
            if (new == to).all():
                break
            to = new
        at = np.flatnonzero((inner & (v > 0)).ravel())
        cell = lambda p: (p // side - 1 + i * tile) * size + p % side - 1 + j * tile
        return pa.table({"cell": pa.array(cell(at)), "value": pa.array(v.ravel()[at]), "to": pa.array(cell(to[at]))})

    return _per_tile(cells, size, sigma, tile, value, 1, make, "cell long, value double, to long")


def peak_count(cells: DataFrame, size: int, sigma: float, value: str = "density", tile: int = TILE) -> int:
    """How many peaks, and so basins, the blurred raster has."""

    def make(i: int, j: int, v: np.ndarray) -> pa.Table:
        inner = v[1:-1, 1:-1]
        own = (np.arange(1, v.shape[0] - 1)[:, None] * v.shape[1]) + np.arange(1, v.shape[1] - 1)[None]
        return pa.table({"n": pa.array([int(((_climb(v) == own) & (inner > 0)).sum())])})

    return _per_tile(cells, size, sigma, tile, value, 1, make, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def basins(cells: DataFrame, size: int, sigma: float, value: str = "density", tile: int = TILE) -> DataFrame:
    """row, col, value, basin of each cell of the blurred raster above 0. Basins are numbered from 0 by their peaks' rows and columns."""
    at = cut(_pointers(cells, size, sigma, tile, value))
    # only cells that some ascent enters from another tile are passed through
    entered = at.where(F.col("cell") != F.col("to")).select(F.col("to").alias("cell")).distinct()
    paths = at.join(entered, "cell", "left_semi").select("cell", "to")
    while True:
        ends = paths.select(F.col("cell").alias("to"), F.col("to").alias("_next"))
        longer = cut(paths.join(ends, "to").select("cell", F.col("_next").alias("to"), (F.col("_next") != F.col("to")).alias("_moved")))
        ended = longer.where("_moved").isEmpty()
        paths = longer.drop("_moved")
        if ended:
            break
    peak = at.join(paths.select(F.col("cell").alias("to"), F.col("to").alias("_end")), "to", "left").select("cell", "value", F.coalesce("_end", "to").alias("peak"))
    numbers = at.where(F.col("cell") == F.col("to")).select(F.col("cell").alias("peak"), (F.row_number().over(Window.orderBy("cell")) - 1).alias("basin"))  # a row a peak
    out = peak.join(numbers, "peak")
    return out.select(F.floor(F.col("cell") / size).cast("int").alias("row"), (F.col("cell") % size).cast("int").alias("col"), "value", "basin")


def least_blur(cells: DataFrame, size: int, most: int, trials: int = 10, value: str = "density", tile: int = TILE) -> float:
    """The least deviation found at which the blurred raster has at most `most` basins: doubled from 2 (halved, if 2 is enough) to bounds, which are bisected
    `trials` times. A job a trial; each counts peaks only."""
    if most < 1:
        raise ValueError("at least one basin must be allowed")
    cells = cells.persist()
    enough = lambda s: peak_count(cells, size, s, value, tile) <= most
    low, high = 1.0, 2.0
    if enough(high):
        while low > LEAST and enough(low):
            low, high = low / 2, low
    else:
        while not enough(high):
            low, high = high, 2 * high
    for _ in range(trials):
        middle = (low + high) / 2
        low, high = (low, middle) if enough(middle) else (middle, high)
    cells.unpersist()
    return high


def basin_of(points: DataFrame, found: DataFrame) -> DataFrame:
    """points (row, col, ...) with their cell's basin. Cells beyond the reach of all mass take the basin with the nearest peak; of equal ones the first.

    found: of basins(). Peaks are a row a basin, whose number the search for a blur bounds.
    """
    joined = points.join(found.select("row", "col", "basin"), ["row", "col"], "left")
    peaks = found.groupBy("basin").agg(F.max_by(F.struct("row", "col"), F.struct("value", -F.col("row"), -F.col("col"))).alias("p"))
    every = peaks.agg(F.sort_array(F.collect_list(F.struct("basin", "p.row", "p.col"))).alias("_peaks"))  # one row
    apart = lambda x: F.pow(x["row"] - F.col("row"), 2) + F.pow(x["col"] - F.col("col"), 2)
    near = F.array_min(F.transform("_peaks", lambda x: F.struct(apart(x).alias("d"), x["basin"].alias("basin"))))["basin"]
    return joined.crossJoin(F.broadcast(every)).withColumn("basin", F.coalesce("basin", near)).drop("_peaks")
