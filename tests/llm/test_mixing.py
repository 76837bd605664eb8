import random

import pytest
from helpers import corpus, frame, words
from pyspark.sql import functions as F

from tidewake.llm import mixing


def share_out(sizes):
    """Targets by the rule as it reads."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight, cap = {s: 1 + k % 3 for k, (s, _) in enumerate(order)}, {s: 3.0 * n for s, n in order}
    left, out = float(sum(n for _, n in order)), {}
    while free := [s for s, _ in order if s not in out]:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * share > cap[s]]
        if not over:
            return out | {s: weight[s] * share for s in free}
        for s in over:
            out[s] = cap[s]
            left -= cap[s]
    return out


@pytest.mark.parametrize("sizes", [[("b", 10), ("a", 100), (None, 5), ("c", 500)], [("a", 300), ("b", 300), ("c", 300)], [("a", 10), ("b", 990)], [("a", 0)], [], [(f"s{k}", k * k) for k in range(90)]])
def test_targets_share_and_stop(spark, sizes):
    got = mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()
    assert {r.source: r.target for r in got} == pytest.approx(share_out(sizes))


def test_flight_keeps_both_totals():
    draw = random.Random(1)
    x = [float(draw.randint(0, 500)) for _ in range(999)]
    p = [0.37] * 999
    mixing.flight(p, x, draw)
    left = [k for k, v in enumerate(p) if 0 < v < 1]
    assert len(left) <= 2 and sum(p) == pytest.approx(999 * 0.37, abs=1e-4) and sum(a * b for a, b in zip(p, x, strict=True)) == pytest.approx(0.37 * sum(x), rel=1e-6)
    mixing.land(p, x, draw)
    assert all(v in (0.0, 1.0) for v in p)


@pytest.mark.parametrize("x", [[5.0], [0.0, 0.0], [900.0, 3.0], [50.0, 40.0, 30.0, 20.0, 11.0, 9.0, 3.0]])
def test_landing_goes_to_the_nearest_total(x):
    """Of few documents, against all ways to take them: within the best by two turns, never worse than rounding."""
    p = [0.4] * len(x)
    mixing.land(p, x, random.Random(4))
    assert set(p) <= {0.0, 1.0} and abs(sum(a * b for a, b in zip(p, x, strict=True)) - 0.4 * sum(x)) <= (max(x) / 2 if len(x) < 7 else 3)


def test_flight_takes_each_with_its_probability():
    hits = [0] * 9
    for s in range(2000):
        p = [0.3] * 9
        draw = random.Random(s)
        mixing.flight(p, [1.0, 2, 3, 4, 5, 6, 7, 8, 90], draw)
        mixing.land(p, [1.0, 2, 3, 4, 5, 6, 7, 8, 90], draw, 1e9, 1e9)
        hits = [a + b for a, b in zip(hits, p, strict=True)]
    assert all(abs(h / 2000 - 0.3) < 0.05 for h in hits)


def test_heavy_tailed_sizes_near_targets(spark):
    """A document of a fifth of its source, and sizes over four orders: each source within half a per cent of its target."""
    rng = random.Random(3)
    rows = [(k, "w " * min(9000, int(3 / (1 - rng.random()) ** 0.9)), "", f"s{k % 4}", 0, 0, "") for k in range(3000)]
    rows += [(9000 + k, "w " * 6000, "", f"s{k}", 0, 0, "") for k in range(4)]
    m = mixing.mixed(frame(spark, rows))
    for r in m.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max(F.col("times")).alias("k")).collect():
        assert abs(r.t - r.g) <= 0.005 * r.g and r.k <= 3


def test_many_repeated_rows_share_no_block(spark):
    rows = [(None, "", "", "a", 0, 0, "")] * 200 + [(7, "one two", "", "a", 0, 0, "")] * 300 + [(k, "w " * 9, "", "b", 0, 0, "") for k in range(100)]
    m = mixing.mixed(frame(spark, rows), block=8)
    assert m.count() == len(rows)
    for r in m.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r.t - r.g) <= 0.02 * r.g


@pytest.mark.parametrize("block", [4096, 8])
def test_totals_near_targets_and_reruns_agree(spark, block):
    rng = random.Random(2)
    rows = [(k, "w " * rng.randint(1, 60), "", f"s{k % 5}", 0, 0, "") for k in range(2000)]
    m = mixing.mixed(frame(spark, rows), block=block)
    for r in m.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max(F.col("times")).alias("k")).collect():
        assert abs(r.t - r.g) < 0.02 * r.g and r.k <= 3
    again = mixing.mixed(frame(spark, rows).repartition(3), block=block)
    assert {r.doc_id: r.taken for r in m.collect()} == {r.doc_id: r.taken for r in again.collect()}


def test_edges(spark):
    m = mixing.mixed(frame(spark)).collect()
    assert len(m) == len(corpus()) and {r.doc_id: r.size for r in m} == {r[0]: len(words(r[1])) for r in corpus()}
    assert mixing.mixed(frame(spark, [])).count() == 0 and mixing.repeat(frame(spark, [])).count() == 0
    assert mixing.repeat(frame(spark)).columns == frame(spark).columns
