import re

from helpers import corpus, frame, prose, words

from tidewake.llm import quality_rules as q


def by_hand(text):
    w, t = words(text, lower=False), text or ""
    lines = [x for x in t.split("\n") if words(x)]
    runs = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    twice, covered = {r for r in runs if runs.count(r) > 1}, set()
    for k, r in enumerate(runs):
        if r in twice:
            covered |= set(range(k, k + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    rows = [r for r in corpus() if len(r[1] or "") < 5000]
    text = "a b c d e f g h i " * 3 + "z\n#x\n#x\n $ |\n" + "q " * 20
    rows.append((999, text, "", "", 0, 0, ""))
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in q.statistics(frame(spark, rows)).collect())
    assert got == sorted((r[0], *by_hand(r[1])) for r in rows)


def test_learns_and_keeps_clean_documents(spark):
    import random

    rng, rows, labels = random.Random(3), [], []
    for k in range(400):
        bad = k % 5 == 0
        t = prose(rng, 60)
        rows.append((k, t.replace(" ", "*** ") if bad else t, "", "", 0, 0, ""))
        labels.append((k, 0 if bad else 1))
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int")
    docs = frame(spark, rows)
    rules = q.fit(docs, lab)
    assert rules
    kept = {r.doc_id for r in q.quality(docs, rules).where("kept").collect()}
    assert kept == {k for k, y in labels if y}
    plan = q.quality(docs, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_base_and_edge_cases(spark):
    d = frame(spark)
    r = {x.doc_id: x for x in q.quality(d, []).collect()}
    assert not r[32].kept and r[32].n_words == 0 and r[0].kept and "class" in d.columns
    assert q.quality(frame(spark, []), []).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert q.fit(d, none) == [] and q.fit(frame(spark, []), none) == []


def test_rules_are_ordered_conditions(spark):
    rules = [q.Rule((q.Term("symbols_per_word", True, 0.5),), 1, 1), q.Rule((q.Term("word_length", False, 2.0), q.Term("upper_share", True, 0.9)), 1, 1)]
    d = frame(spark, [(1, "# # # # # a", "", "", 0, 0, ""), (2, "AB CD", "", "", 0, 0, ""), (3, "abc def", "", "", 0, 0, "")])
    assert {r.doc_id: r.v for r in q.statistics(d).select("doc_id", q.verdict(rules).alias("v")).collect()} == {1: False, 2: False, 3: True}


def test_columns_with_the_names_of_working_columns_stay(spark):
    d = spark.createDataFrame([(1, "some words here", 5, "x", 9, "y")], "doc_id long, text string, _h int, _line string, _row int, _at string")
    r = q.quality(d, []).first()
    assert (r._h, r._line, r._row, r._at, r.n_words) == (5, "x", 9, "y", 3)


def test_held_out_verdicts(spark):
    """Rules fitted on two thirds of labelled rows, judged on a third that the fit has not seen."""
    import random

    from helpers import prose

    rng, rows = random.Random(13), []
    for k in range(900):
        bad = k % 3 == 0
        t = prose(rng, rng.randint(30, 90))
        if bad:
            t = " ".join(w + rng.choice(["", " #", " $$", " |"]) for w in t.split())
        rows.append((k, t, int(not bad)))
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    rules = q.fit(d.where("doc_id % 9 < 6"), d.where("doc_id % 9 < 6").select("doc_id", "quality"))
    got = q.quality(d.where("doc_id % 9 >= 6"), rules).select("quality", "kept").collect()
    assert sum(r.kept == bool(r.quality) for r in got) >= 0.95 * len(got)
