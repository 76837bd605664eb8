import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages_by_turn(spark):
    import corpus_pipeline as p
    from tidewake.llm import decontaminate, ngram_join

    df = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [df.count()]
    for name, stage in p.STAGES[:3]:
        df = stage(spark, df, SF).cache()
        assert df.columns == list(p.COLUMNS), name
        seen.append(df.count())
    assert seen[0] > seen[1] > seen[2] >= seen[3] > 0.4 * seen[0]
    assert ngram_join.jaccard_components(df).where("doc_id <> component_id").count() == 0
    assert decontaminate.leaks(df, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    df = p.STAGES[3][1](spark, df, SF)
    last = p.STAGES[4][1](spark, df, SF)
    assert last.count() == df.count() and set(last.columns) == {*p.COLUMNS, "shard", "slot"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["op5_ngram_jaccard", "op9_warc", "op10_url_filters"])
def test_rows_equal_sql(spark, name):
    from compare import differences

    from tidewake.llm import queries as q

    assert differences(q.queries()[name](spark, SF), q.oracle_sql()[name], SF) == ""


def test_near_duplicates_are_judged_by_row(spark):
    """A row with a repeated doc_id and another text is neither merged with, nor dropped for, the other row of that doc_id."""
    import random

    from helpers import frame, prose

    import corpus_pipeline as p

    a, b, c = (prose(random.Random(k), 80) for k in range(3))
    rows = [(1, a), (5, a + " more"), (5, b), (7, b), (7, c), (8, c), (8, c), (None, a), (9, None), (10, "")]
    got = p.near_duplicates_stage(spark, frame(spark, [(i, t, "", "", 0, 0, "") for i, t in rows]), "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(1, a), (5, b), (7, c), (0, a), (9, ""), (10, "")])


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("k", range(5))
def test_stage_edges(spark, k):
    """Nulls, empty and long texts, ties, a repeated row, columns of clashing names; rows without an id; an empty table."""
    from helpers import corpus, frame

    import corpus_pipeline as p

    extra = [(None, "a text without an id " * 20, None, None, None, 1, "y"), (700, None, "en", "a", 0, 0, "z"), (701, "", None, None, None, None, None)]
    name, stage = p.STAGES[k]
    d = frame(spark, corpus() + extra)
    out = stage(spark, d, SF)
    names = [*p.COLUMNS, "shard", "slot"] if k == 4 else list(p.COLUMNS)
    assert out.columns == names
    rows, ids = out.collect(), {r[0] for r in corpus() + extra}
    assert {r.doc_id for r in rows} <= ids and (k in (0, 1) or None in {r.doc_id for r in rows})
    if k == 4:
        assert len(rows) == len(corpus()) + len(extra)
    if k in (1, 2):
        assert {700, 701} <= {r.doc_id for r in rows} and None in {r.doc_id for r in rows}
    assert stage(spark, frame(spark, []), SF).count() == 0
