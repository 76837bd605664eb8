import random

import pytest
from pyspark.sql import functions as F

from tidewake.plans.config import Metadata
from tidewake.sources import clips


@pytest.fixture
def dataset(tmp_path):
    d = tmp_path / "clip_data"
    d.mkdir()
    (d / "a.1.csv").write_text("0.5,1,2\n1.5,1,0\n")
    (d / "b.csv").write_text("2.5,2,1\n")
    meta = Metadata("d", 2.0, ["AccX", "individual_id", "label"], ["unknown", "rest", "walk"], ["a", "b"], {"a": 1, "b": 2, "c": 3}, {0: ["a"], 1: ["b"]}, 2)
    return d, meta


def test_clips_keep_their_order(spark, dataset, tmp_path):
    d, meta = dataset
    f = clips.read_clips(spark, str(d), meta)
    assert sorted(map(tuple, f.collect())) == [("a", 0, 0.5, 1, 2), ("a", 1, 1.5, 1, 0), ("b", 0, 2.5, 2, 1)]
    g = clips.ingest(spark, str(d), meta, str(tmp_path / "frames"))
    assert g.count() == 3 and set(g.columns) == set(f.columns)
    assert sorted((r.clip_id, r.individual_id, r.fold) for r in clips.clip_table(spark, meta).collect()) == [("a", 1, 0), ("b", 2, 1)]


def test_missing_values_fail(spark, dataset):
    d, meta = dataset
    (d / "b.csv").write_text("2.5,,1\n")
    with pytest.raises(Exception, match="individual_id"):
        clips.read_clips(spark, str(d), meta).collect()


def test_predictions(spark, dataset, tmp_path):
    d, meta = dataset
    f = clips.read_clips(spark, str(d), meta)
    p = tmp_path / "predictions"
    p.mkdir()
    (p / "a.csv").write_text("1\n2\n")
    with pytest.raises(ValueError):
        clips.align(f, clips.read_predictions(spark, str(p)))
    (p / "b.csv").write_text("1\n")
    got = clips.align(f, clips.read_predictions(spark, str(p)))
    assert {(r.clip_id, r.t): r.pred for r in got.collect()} == {("a", 0): 1, ("a", 1): 2, ("b", 0): 1}
    clips.export_predictions(got, str(tmp_path / "out"))
    assert sorted(x.name for x in (tmp_path / "out").glob("clip_id=*")) == ["clip_id=a", "clip_id=b"]


def test_documents_and_results(spark, tmp_path):
    clips.write_document(spark, {"sr": 5, "label_names": ["unknown"]}, str(tmp_path / "m"))
    assert clips.read_yaml(spark, str(tmp_path / "m"))["sr"] == 5
    t = spark.createDataFrame([(1, 0.5)], "label int, f1 double")
    clips.write_results({"labels": t}, str(tmp_path / "r"), fold=1)
    clips.write_results({"labels": t}, str(tmp_path / "r"), fold=2)
    assert clips.read_results(spark, str(tmp_path / "r"), "labels", fold=2).count() == 1


def test_ranges_that_cut_lines_keep_order(spark, tmp_path):
    rng = random.Random(1)
    want = {}
    for name in ("one", "two", "three"):
        rows = [(round(rng.uniform(-9, 9), rng.randint(0, 9)), rng.randrange(3), rng.randrange(4)) for _ in range(rng.randint(1, 400))]
        (tmp_path / f"{name}.csv").write_bytes(("\r\n" if name == "two" else "\n").join(f"{a},{b},{c}" for a, b, c in rows).encode() + (b"\n" if name == "one" else b""))
        want |= {(name, t): r for t, r in enumerate(rows)}
    meta = Metadata("toy", 1.0, ["x", "individual_id", "label"], ["unknown"], [], {}, {})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        d = clips.read_clips(spark, str(tmp_path), meta)
        assert d.select(F.spark_partition_id()).distinct().count() >= 1 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        assert {(r.clip_id, r.t): (r.x, r.individual_id, r.label) for r in d.collect()} == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_files_of_predictions_do_not_grow_with_clips(spark, tmp_path):
    p = spark.range(3000).selectExpr("id % 500 AS clip_id", "id div 500 AS t", "cast(id % 7 AS int) AS pred").repartition(3)
    clips.write_predictions(p, str(tmp_path / "p"))
    assert 1 <= len(list((tmp_path / "p").rglob("*.parquet"))) <= 8
    got = spark.read.parquet(str(tmp_path / "p"))
    assert dict(got.dtypes) == dict(p.dtypes) and sorted(map(tuple, got.select("clip_id", "t", "pred").collect())) == sorted(map(tuple, p.collect()))
