import pytest

from tidewake.operators import crossval, evaluate
from tidewake.operators import frames as fr


def make(spark, rows, cols="clip_id string, t long, individual_id int, label int, pred int"):
    return spark.createDataFrame(rows, cols)


def of(spark, y, pred, clip="a", who=1):
    return make(spark, [(clip, k, who, a, b) for k, (a, b) in enumerate(zip(y, pred, strict=True))])


def test_map_fills_empty_clusters_and_breaks_ties_low(spark):
    c = evaluate.contingency(of(spark, [0, 1, 1, 2, 2, 0], [0, 0, 0, 1, 1, 1]))
    assert {r.pred: r.label for r in evaluate.cluster_map(c, 3).collect()} == {0: 1, 1: 2, 2: 0}
    c = evaluate.contingency(of(spark, [1, 2], [0, 0]))
    assert {r.pred: r.label for r in evaluate.cluster_map(c, 1).collect()} == {0: 1}


def test_a_cluster_without_entry_fails(spark):
    f = of(spark, [1], [5])
    m = evaluate.cluster_map(evaluate.contingency(of(spark, [1], [0])), 2)
    with pytest.raises(Exception, match="cluster map"):
        evaluate.apply_map(f, m).collect()


def test_absent_labels_score_one(spark):
    s = evaluate.label_scores(evaluate.contingency(of(spark, [1, 1, 2, 2], [1, 1, 2, 2])), [1, 2, 3])
    assert {r.label: (r.precision, r.recall, r.f1) for r in s.collect()}[3] == (1.0, 1.0, 1.0)
    assert evaluate.macro_scores(s).first().macro_f1 == 1.0
    s = evaluate.label_scores(evaluate.contingency(of(spark, [1, 1, 1], [2, 2, 2])), [1, 2])
    assert {r.label: (r.precision, r.recall, r.f1) for r in s.collect()} == {1: (1.0, 0.0, 0.0), 2: (0.0, 1.0, 0.0)}
    m = evaluate.macro_scores(s).first()
    assert (m.macro_precision, m.macro_recall, m.macro_f1) == (0.5, 0.5, 0.0)


def test_unknown_predictions_shift_when_supervised(spark):
    f = evaluate.supervised(of(spark, [1, 2], [0, 2]))
    assert evaluate.macro_scores(evaluate.label_scores(evaluate.contingency(f), [1, 2])).first().macro_f1 == 1.0


def test_bouts(spark):
    f = of(spark, [1] * 6, [1, 1, 2, 2, 2, 1])
    assert evaluate.time_scale_ratio(f, 2, 1.0).first().time_scale_ratio == 1.0
    two = of(spark, [1, 1], [1, 1], "a").unionByName(of(spark, [1, 1], [2, 2], "b"))
    assert evaluate.bouts(two).first().bouts == 2
    one = of(spark, [1, 1], [1, 1], "a").unionByName(of(spark, [1, 1], [1, 1], "b"))
    assert evaluate.bouts(one).first().bouts == 1
    # '-' comes before '.' in file names, so a-b.csv is before a.csv
    odd = of(spark, [1], [1], "a").unionByName(of(spark, [1, 1], [1, 2], "a-b"))
    assert evaluate.bouts(odd).first().bouts == 3


def test_homogeneity(spark):
    h = lambda y, p: evaluate.homogeneity(evaluate.contingency(of(spark, y, p))).first().homogeneity
    assert h([1, 1, 2, 2], [7, 7, 3, 3]) == pytest.approx(1)
    assert h([1, 1, 2, 2], [7, 7, 7, 7]) == pytest.approx(0)
    assert h([1, 1, 1], [7, 3, 3]) == 1


def test_confusion_leaves_unknown_predictions_out(spark):
    c = evaluate.confusion(evaluate.contingency(of(spark, [1, 1, 2], [0, 1, 1])), [1, 2])
    assert {(r.label, r.pred): r.n for r in c.collect()} == {(1, 1): 1, (1, 2): 0, (2, 1): 1, (2, 2): 0}


def test_groups_without_annotation_are_marked(spark):
    f = of(spark, [1, 2], [1, 2], "a", 1).unionByName(of(spark, [0, 0], [1, 2], "b", 2))
    got = {r.individual_id: (r.annotated, r.macro_f1) for r in evaluate.scored(f, [1, 2], ["individual_id"]).collect()}
    assert got == {1: (True, 1.0), 2: (False, None)}


def test_evaluate_learns_on_train(spark):
    from pyspark.sql import functions as F

    f = of(spark, [1, 1, 2, 2], [0, 0, 1, 1], "a", 1).withColumn("split", F.lit("train")).unionByName(of(spark, [2, 1], [0, 0], "b", 2).withColumn("split", F.lit("test")))
    out = evaluate.evaluate(f, [1, 2], 3)
    assert {r.pred: r.label for r in out["mapping"].collect()} == {0: 1, 1: 2, 2: 0}
    assert {r.split: round(r.macro_f1, 4) for r in out["overall"].collect()} == {"train": 1.0, "test": round((2 / 3 + 0) / 2, 4)}


def test_cross_validation(spark):
    i = spark.createDataFrame([("test", 0.5), ("test", 1.0), ("test", 0.0)], "split string, macro_f1 double")
    r = crossval.summary(i).first()
    assert (r.f1_mean, round(r.f1_std, 6)) == (0.5, 0.408248)
    b = spark.createDataFrame([(3, 0.5), (1, 0.5), (2, 0.1)], "config_id int, macro_f1 double")
    assert crossval.best(b).first().config_id == 1
    c = spark.createDataFrame([(1, 1, 3), (1, 2, 1), (1, 1, 4)], "label int, pred int, n long")
    assert {(r.pred): (r.n, r.share) for r in crossval.summed_confusion(c).collect()} == {1: (7, 0.875), 2: (1, 0.125)}


def test_balanced_sample(spark):
    rows = [("a", k, 1, y, 0) for k, y in enumerate([1] * 5 + [2] * 2 + [3] * 3)] + [("b", k, 2, y, 0) for k, y in enumerate([1] * 5 + [2] * 2)]
    got = fr.balanced(make(spark, rows), [1, 2, 3]).groupBy("individual_id", "label").count().collect()
    assert {(r.individual_id, r.label): r["count"] for r in got} == {(1, 1): 2, (1, 2): 2, (1, 3): 2}
    m = fr.balanced_mask(make(spark, rows), [1, 2, 3])
    assert m.count() == len(rows) and m.where("label <> 0").count() == 6


def test_windows_and_truncation(spark):
    f = make(spark, [("a", k, 1, 1, 0) for k in range(10)])
    assert sorted(r.t for r in fr.window_starts(f, 4).collect()) == list(range(6))
    assert fr.whole_windows(f, 4).count() == 8
    assert {r.t: r["values"] for r in fr.trailing_windows(f.where("t < 3"), 3, "t").collect()} == {0: [2, 1, 0], 1: [1, 0, 1], 2: [0, 1, 2]}


def test_split_lookup_and_completeness(spark):
    f = make(spark, [("a", 0, 1, 1, 0), ("z", 0, 1, 1, 0)])
    clips = spark.createDataFrame([("a", 0), ("b", 1)], "clip_id string, fold int")
    assert {(r.clip_id, r.fault) for r in fr.unmatched_clips(f, clips).collect()} == {("z", "no metadata"), ("b", "no samples")}
    with pytest.raises(ValueError):
        fr.checked(f, clips)


def test_shuffling_rows_changes_nothing(spark):
    f = of(spark, [0, 1, 2, 1, 2, 2, 1], [0, 1, 1, 2, 2, 0, 1])
    a = evaluate.bouts(f.repartition(3)).first().bouts
    assert a == evaluate.bouts(f.orderBy("pred").coalesce(1)).first().bouts
