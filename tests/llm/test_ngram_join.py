from collections import defaultdict

import numpy as np
from helpers import corpus, frame, prose, words

from tidewake.llm import graph, ngram_join


def brute(rows):
    sets = {}
    for r in rows:
        w = words(r[1])
        sets[r[0]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                o = len(sets[a] & sets[b])
                if 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                    x, y = top(a), top(b)
                    parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), top(i)) for i in ids)


def test_equals_brute_force(spark):
    """Copies, near copies in a chain, a group around one text, short texts, nulls, a repeated row."""
    import random

    rng = random.Random(4)
    base = prose(rng, 120).split(" ")
    rows = corpus()
    for k in range(40):
        w = list(base)
        for j in rng.sample(range(len(w)), k % 4):
            w[j] = f"new{k}x{j}"
        rows.append((100 + k, " ".join(w), "", "", 0, 0, ""))
    got = sorted({(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, rows)).collect()})
    assert got == brute(rows)


def test_rows_without_id_and_empty_table(spark):
    t = prose(__import__("random").Random(1), 50)
    r = ngram_join.jaccard_components(frame(spark, [(None, t, "", "", 0, 0, ""), (5, t, "", "", 0, 0, ""), (None, "alone words", "", "", 0, 0, "")])).collect()
    assert sorted((x.doc_id or -1, x.component_id or -1) for x in r) == [(-1, -1), (-1, 5), (5, 5)]
    assert ngram_join.jaccard_components(frame(spark, [])).count() == 0


def test_similar_is_exact_at_the_threshold():
    x = np.arange(1, 10, dtype=np.int64) << 55
    assert ngram_join.similar(x[:8], x[:8], 8, 8) and ngram_join.similar(x[:8], x[:9], 8, 9)
    assert ngram_join.similar(x[:4], x[:4], 5, 4) and not ngram_join.similar(x[1:6], x[1:6], 6, 7)


def test_very_full_buckets_and_many_parts(spark, monkeypatch):
    """Shingles that are ordered by their bucket's count, not dealt by hash, and small parts give the same components."""
    monkeypatch.setattr(ngram_join, "HEAVY", 3)
    monkeypatch.setattr(ngram_join, "DEAL", 64)
    test_equals_brute_force(spark)


def test_group_of_near_copies_costs_few_pairs(spark, monkeypatch):
    """400 texts made from one: pairs in proportion to the group, one component."""
    import random

    rng, seen = random.Random(9), []
    base = prose(rng, 150).split(" ")
    rows = [(0, " ".join(base), "", "", 0, 0, "")]
    for k in range(1, 400):
        w = list(base)
        w[rng.randrange(len(w))] = f"x{k}"
        w[rng.randrange(len(w))] = f"y{k}"
        rows.append((k, " ".join(w), "", "", 0, 0, ""))
    own = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, sets: seen.append(pairs.count()) or own(pairs, sets))
    got = ngram_join.jaccard_components(frame(spark, rows)).collect()
    assert {r.component_id for r in got} == {0} and sum(seen) < 4000


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 9), (-7, 3), (10, 11), (11, 12), (12, 13), (13, 14)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = defaultdict(int, {1: -7, 2: -7, 3: -7, -7: -7, 4: 4, 5: 4, 10: 10, 11: 10, 12: 10, 13: 10, 14: 10})
    assert got == dict(want)


def test_very_long_texts_link(spark):
    base = [f"w{k}" for k in range(620_000)]
    other = list(base)
    other[310_000] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(base[:250_000]))]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
