import random
import zlib
from collections import Counter

import pytest
from helpers import corpus, frame, prose
from pyspark.sql import functions as F

from tidewake.llm import sharding

SIZE = "octet_length(coalesce(text, '')) + 16"


def test_all_rows_in_even_gapless_shards(spark):
    s = sharding.two_pass_shuffle(frame(spark), F.expr(SIZE), 7, bucket_bytes=2000)
    rows = s.collect()
    assert Counter((r.doc_id, r.text, r._h, r["class"]) for r in rows) == Counter((r[0], r[1], r[5], r[6]) for r in corpus())
    by = {k: sorted(r.slot for r in rows if r.shard == k) for k in range(7)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_seeded_and_mixed(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    place = lambda s: {r.doc_id: r.shard + 10 * r.slot for r in sharding.two_pass_shuffle(d, F.expr(SIZE), 10, bucket_bytes=4000, seed=s).collect()}
    a = place(1)
    assert a == place(1) and a != place(2)
    n = len(a)
    mean = sum(a.values()) / n
    cov = sum((k - (n - 1) / 2) * (v - mean) for k, v in a.items()) / sum((k - (n - 1) / 2) ** 2 for k in a)
    assert abs(cov) < 0.08  # places don't follow ids


def test_native_plan_and_edges(spark):
    plan = sharding.two_pass_shuffle(frame(spark), F.expr(SIZE))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert sharding.two_pass_shuffle(frame(spark, []), F.expr(SIZE)).count() == 0
    d = {r.doc_id: (r.size, r.text_crc32) for r in sharding.digest(frame(spark)).collect()}
    assert d[32] == (16, 0) and d[35] == (19, zlib.crc32(b"one"))


def test_many_repeats_are_spread(spark):
    """A row repeated 500 times doesn't fill one bucket, and none is lost."""
    rows = [(1, "same text", "", "", 0, 0, "")] * 500 + [(k, f"t{k}", "", "", 0, 0, "") for k in range(2, 60)]
    s = sharding.two_pass_shuffle(frame(spark, rows), F.expr(SIZE), 8, bucket_bytes=2000).collect()
    assert Counter(r.doc_id for r in s) == Counter(r[0] for r in rows)
    per = Counter(r.shard for r in s)
    assert max(per.values()) - min(per.values()) <= 1 and len({(r.shard, r.slot) for r in s}) == len(rows)
    assert all(any(r.doc_id == 1 for r in s if r.shard == k) for k in range(8))


def test_written_shards(spark, tmp_path):
    sharding.write_shards(frame(spark), str(tmp_path / "s"), size=F.expr(SIZE), shards=3)
    r = spark.read.parquet(str(tmp_path / "s")).collect()
    assert len(r) == len(corpus()) and {x.shard for x in r} == {0, 1, 2}


@pytest.mark.parametrize("held", [1 << 15, 3])
def test_order_depends_on_the_records_alone(spark, monkeypatch, held):
    monkeypatch.setattr(sharding, "PARTITIONS", held)  # fewer partitions than buckets, too
    rng = random.Random(9)
    df = spark.createDataFrame([(k, prose(rng, rng.randint(1, 60))) for k in range(500)], "doc_id long, text string")
    results = set()
    try:
        for partitions, adaptive in ((5, "true"), (8, "false"), (40, "true")):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            got = sharding.two_pass_shuffle(df.repartition(partitions), sharding.size_of(F.col("text")), shards=7, bucket_bytes=9000).collect()
            results.add(tuple(sorted((r.shard, r.slot, r.doc_id) for r in got)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(results) == 1
    order = [x[2] for x in sorted(results.pop())]
    assert sorted(order) == list(range(500)) and order != sorted(order)
