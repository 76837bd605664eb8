import math
import random

import pytest
from pyspark.sql import functions as F

from tidewake.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, score int, anchor string"


def brute(rows, every, positives=5, negatives=3):
    best = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = (label, [math.floor(256 * x) for x in v])
        best[i] = min(best.get(i, q), q)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    out = []
    for a, (label, v) in best.items():
        if a % every:
            continue
        scored = sorted((-dot(v, w), i, m == label) for i, (m, w) in best.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fit = [(i, -n) for n, i, same in scored if not same and 50 * -s <= 100 * -n <= 95 * -s][:negatives]
            out += [(a, p, k + 1, i, -s, n) for k, (i, n) in enumerate(fit)]
    return sorted(out)


def result(spark, rows, every, **how):
    df = spark.createDataFrame([(i, v, label, 0, "x") for i, v, label in rows], SCHEMA)
    whole = hn.integer_rows(df, "vec_id", "label", "embedding")
    return sorted(map(tuple, hn.hard_negatives(whole, whole.where(F.col("id") % every == 0), **how).collect()))


def made(seed, n, labels=3, width=6):
    rng = random.Random(seed)
    return [(k, [round(rng.gauss(0.3, 0.5), 3) for _ in range(width)], rng.randrange(labels)) for k in range(n)]


@pytest.mark.parametrize("blocks", [1 << 22, 60])
def test_equal_to_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(hn, "BLOCK", blocks)
    rows = made(1, 240)
    assert result(spark, rows, 10) == brute(rows, 10)
    assert len(brute(rows, 10)) > 100


def test_few_cells_at_once(spark, monkeypatch):
    monkeypatch.setattr(hn, "CELLS", 50)
    rows = made(2, 100)
    assert result(spark, rows, 5, positives=2, negatives=1) == brute(rows, 5, 2, 1)


def test_nulls_ties_repeats_and_zero_scores(spark):
    rows = made(3, 60, labels=2)
    rows += [(100, None, 1), (101, [0.5] * 6, None), (102, [None] + [0.5] * 5, 1), (103, [float("nan")] * 6, 0), (104, [float("inf")] * 6, 0), (None, [0.5] * 6, 1)]
    rows += [(k, [0.5] * 6, k % 2) for k in range(110, 150)]  # one vector many times
    rows += [(k, [0.0] * 6, k % 2) for k in range(150, 165)]  # scores of zero, where positives and negatives tie
    rows += [rows[7], (8, [0.1] * 6, 1), (170, [0.25, 0.5], 0)]
    want = brute(rows, 10)
    assert any(r[4] == 0 for r in want)
    assert result(spark, rows, 10) == want


def test_large_components_stay_exact(spark):
    rows = [(k, [1000.0 * k + 1, -(2.0**15) * k], k % 2) for k in range(40)]
    assert result(spark, rows, 4) == brute(rows, 4)
    with pytest.raises(Exception, match="beyond 64 bits"):
        result(spark, [(k, [1e15 * (k + 1)], k % 2) for k in range(4)], 2)


def test_empty(spark):
    assert result(spark, [], 10) == []
    assert result(spark, [(50, [0.5], 1)], 10) == []
