import heapq
import random

import numpy as np
import pytest

from tidewake.operators import basins


def cloud(size, n, seed=0, centres=5):
    rng = random.Random(seed)
    spots = [(rng.uniform(2, size - 2), rng.uniform(2, size - 2)) for _ in range(centres)]
    out = {}
    for _ in range(n):
        r, c = rng.choice(spots)
        p = tuple(min(size - 1, max(0, int(rng.gauss(x, size / 12)))) for x in (r, c))
        out[p] = out.get(p, 0) + 1
    return out


def table(spark, cells):
    return spark.createDataFrame([(r, c, float(v)) for (r, c), v in cells.items()], "row int, col int, density double")


def whole(cells, size, sigma):
    """The blurred raster by matrices: each axis with mirrored edges."""
    dense, w = np.zeros((size, size)), basins.kernel(sigma)
    for p, v in cells.items():
        dense[p] = v
    m = np.zeros((size, size))
    for i in range(size):
        for k, x in enumerate(w):
            j = (i + k - len(w) // 2) % (2 * size)
            m[i, j if j < size else 2 * size - 1 - j] += x
    return np.round(m @ dense @ m.T, 12)


def flood(v):
    """Basins by flooding from the top: cells by falling value join the first neighbour that was reached."""
    size, label, order = len(v), {}, sorted(((-v[r, c], r, c) for r in range(len(v)) for c in range(len(v)) if v[r, c] > 0))
    heapq.heapify(order)
    while order:
        _, r, c = heapq.heappop(order)
        near = [(-v[a, b], a, b) for a in range(max(0, r - 1), min(size, r + 2)) for b in range(max(0, c - 1), min(size, c + 2)) if (a, b) in label]
        label[r, c] = label[min(near)[1:]] if near else (r, c)
    return label


@pytest.mark.parametrize(("size", "sigma", "tile"), [(20, 1.5, 7), (20, 6.0, 8), (33, 2.0, 16), (9, 5.0, 64)])
def test_blur_and_basins_equal_a_flood(spark, size, sigma, tile):
    cells = cloud(size, 300, seed=size)
    want = whole(cells, size, sigma)
    got = {(r.row, r.col): r.value for r in basins.blurred(table(spark, cells), size, sigma, tile=tile).collect()}
    assert all(abs(got.get((r, c), 0.0) - want[r, c]) < 1e-9 for r in range(size) for c in range(size))
    exact = np.zeros((size, size))
    for p, v in got.items():
        exact[p] = v
    label = flood(exact)
    found = {(r.row, r.col): r.basin for r in basins.basins(table(spark, cells), size, sigma, tile=tile).collect()}
    peaks = sorted(set(label.values()))
    assert found == {p: peaks.index(top) for p, top in label.items()}
    assert basins.peak_count(table(spark, cells), size, sigma, tile=tile) == len(peaks)


def test_the_search_finds_the_least_blur_with_few_basins(spark):
    size, cells = 40, table(spark, cloud(40, 400, seed=3))
    s = basins.least_blur(cells, size, 4, trials=6, tile=20)
    assert basins.peak_count(cells, size, s, tile=20) <= 4 < basins.peak_count(cells, size, s / 2, tile=20)
    found = basins.basins(cells, size, s, tile=20)
    assert {r.basin for r in found.select("basin").distinct().collect()} <= set(range(4))
    points = spark.createDataFrame([(k, k, k) for k in range(size)], "id int, row int, col int")
    assert basins.basin_of(points, found).where("basin IS NULL").count() == 0


def test_far_cells_and_plain_rasters(spark):
    cells = {(2, 2): 1.0, (2, 60): 1.0}
    found = basins.basins(table(spark, cells), 64, 1.0, tile=16)
    points = spark.createDataFrame([(1, 60, 5), (2, 60, 62), (3, 2, 2)], "id int, row int, col int")
    assert {r.id: r.basin for r in basins.basin_of(points, found).collect()} == {1: 0, 2: 1, 3: 0}
    empty = table(spark, {(0, 0): 1.0}).where("row > 0")
    assert basins.basins(empty, 64, 1.0).count() == 0 and basins.least_blur(empty, 64, 3, trials=1) < 1
