import random
from collections import defaultdict

import numpy as np
from helpers import corpus, frame, prose, words

from tidewake.llm import compact_windows as c
from tidewake.llm.textnum import U, mix


def test_windows_are_the_cartesian_trees_long_nodes():
    rng = np.random.default_rng(0)
    for _ in range(150):
        lens = rng.integers(0, 40, rng.integers(1, 5))
        begin = np.concatenate(([0], np.cumsum(lens)))
        h, n = mix(rng.integers(0, 2**63, begin[-1]).astype(U)), int(rng.integers(1, 9))
        d, left, m, right, _ = c.windows(h, begin, n)
        want = []
        for k in range(len(lens)):
            x = h[begin[k] : begin[k + 1]].tolist()
            for i in range(len(x)):
                a = b = i
                while a > 0 and x[a - 1] > x[i]:
                    a -= 1
                while b + 1 < len(x) and x[b + 1] > x[i]:
                    b += 1
                if b - a + 1 >= n:
                    want.append((k, a, i, b))
        assert sorted(zip(d.tolist(), left.tolist(), m.tolist(), right.tolist(), strict=True)) == sorted(want)


def test_repeated_passages_are_found_and_clean_texts_are_not(spark):
    rows = corpus()
    got = {r.doc_id for r in c.passages(frame(spark, rows)).collect()}
    seen = defaultdict(set)
    for r in rows:
        w = words(r[1])
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])].add(r[0])
    want = set().union(*(s for s in seen.values() if len(s) > 1))
    assert want <= got
    clean = [(k, prose(random.Random(k + 50), 200), "", "", 0, 0, "") for k in range(20)]
    assert c.passages(frame(spark, clean)).count() == 0


def test_near_passages_and_their_places(spark):
    rng = random.Random(9)
    p = prose(rng, 120).split()
    q = list(p)
    q[60] = "changed"
    a, b = prose(rng, 70).split(), prose(rng, 33).split()
    rows = [(1, " ".join(a + p), "", "", 0, 0, ""), (2, " ".join(b + q + a[:9]), "", "", 0, 0, "")]
    r = {x.doc_id: x for x in c.passages(frame(spark, rows)).collect()}
    assert r[1].partner_id == 2 and r[1].start_word <= 75 and r[1].end_word >= 185 and r[1].similarity >= 0.8
    assert r[1].start_word - r[1].partner_start_word == 70 - 33


def test_copies_nulls_and_empty(spark):
    t = prose(random.Random(1), 80)
    rows = [(k, t, "", "", 0, 0, "") for k in (4, 2, 9)] + [(None, t, "", "", 0, 0, ""), (5, None, "", "", 0, 0, ""), (6, "", "", "", 0, 0, "")]
    assert {(r.doc_id, r.partner_id) for r in c.passages(frame(spark, rows)).collect()} == {(4, 2), (9, 2), (2, 9)}
    assert c.passages(frame(spark, [])).count() == 0


def test_verification_of_insertions_and_deletions_in_longer_texts():
    """Up to two words put in or taken out in the middle of a passage, in segments padded as the search pads them."""
    rng = np.random.default_rng(3)
    seq = lambda w: c.shingles(w, np.array([0, len(w)]), c.SIZE)[0]
    new = lambda n: rng.integers(0, 2**63, n).astype(U)
    for n in (50, 60, 70, 80, 89):
        for k in (1, 2):
            p, left = new(n), int(rng.integers(8, 40))
            q = np.concatenate((p[: n // 2], new(k), p[n // 2 :]))
            a, b = seq(np.concatenate((new(left), p, new(30)))), seq(np.concatenate((new(left), q, new(30))))
            for u, v, d in ((a, b, 0), (b, a, 0), (a, b, k), (b, a, -k)):
                r = c.compare(u, v, d, 50)
                assert r and r[0][3] >= 0.8 and left - 8 <= r[0][0] <= left + n
            assert c.compare(a, seq(np.concatenate((new(left), p[: n // 4], new(n - n // 4 + 30)))), 0, 50) == []


def test_recall_of_passages_at_the_least_similarity(spark):
    """Passages of one window with one word changed in the middle (41 of 51 shingles)."""
    rng = random.Random(21)
    rows = []
    for k in range(100):
        p = [f"{w}{rng.randint(0, 999)}" for w in prose(rng, 50).split()]
        for side in (0, 1):
            q = list(p)
            q[25] = f"other{side}"
            rows.append((2 * k + side, prose(rng, 40 + 7 * side) + " " + " ".join(q) + " " + prose(rng, 40), "", "", 0, 0, ""))
    got = {(r.doc_id, r.partner_id) for r in c.passages(frame(spark, rows)).collect()}
    assert sum((2 * k, 2 * k + 1) in got for k in range(100)) >= 96 and all(a // 2 == b // 2 for a, b in got)


def test_two_passages_on_one_diagonal_are_two_spans():
    rng = np.random.default_rng(5)
    new = lambda n: rng.integers(0, 2**63, n).astype(U)
    p, q = new(60), new(70)
    a, b = np.concatenate((p, new(80), q)), np.concatenate((p, new(80), q))
    got = c.compare(a, b, 0, 50)
    assert len(got) == 2 and np.abs(np.array([g[:2] for g in got]) - [(0, 60), (140, 210)]).max() <= 6 and all(s == 1.0 for *_, s in got)


def test_passages_around_a_very_frequent_line_meet(spark):
    """A line of 20 words in 300 texts, in 40 pairs of them within a shared passage of 60 words; all other surroundings differ."""
    rng = random.Random(31)
    wide = lambda n: [f"{w.strip('.,')}{rng.randint(0, 9999)}" for w in prose(rng, n).split()]
    line = wide(20)
    rows = [(k, " ".join([*wide(60), *line, *wide(60)]), "", "", 0, 0, "") for k in range(220)]
    for k in range(40):
        p = [*wide(20), *line, *wide(20)]
        rows += [(1000 + 2 * k + s, " ".join([*wide(30 + 9 * s), *p, *wide(30)]), "", "", 0, 0, "") for s in (0, 1)]
    r = c.passages(frame(spark, rows)).collect()
    pairs = {(x.doc_id, x.partner_id) for x in r}
    assert sum((1000 + 2 * k, 1001 + 2 * k) in pairs for k in range(40)) >= 36
    assert all(a // 2 == b // 2 and a >= 1000 for a, b in pairs)


def test_membership_of_drifting_passages(spark):
    """Chains of texts whose passages drift: every pair that shares a passage by brute force is in one cluster, and other chains in others."""
    rng, rows = random.Random(77), []
    for chain in range(6):
        p = [f"{w}{rng.randint(0, 999)}" for w in prose(rng, 60).split()]
        for k in range(12):
            p = list(p)
            p[rng.randrange(60)] = f"d{chain}x{k}"
            rows.append((100 * chain + k, " ".join([prose(rng, 40), *p, prose(rng, 40)]), "", "", 0, 0, ""))
    cluster = {x.doc_id: x.cluster_id for x in c.passages(frame(spark, rows)).collect()}
    sets = {i: [{tuple(w[j : j + 5]) for j in range(k, k + 46)} for k in range(len(w) - 49)] for i, w in ((r[0], words(r[1])) for r in rows)}
    true = [(a, b) for a in sets for b in sets if a < b and a // 100 == b // 100 and any(len(x & y) >= 0.8 * len(x | y) for x in sets[a] for y in sets[b])]
    assert len(true) > 50 and sum(a in cluster and cluster[a] == cluster.get(b) for a, b in true) >= 0.9 * len(true)
    assert all(cluster[i] // 100 == i // 100 for i in cluster)


def test_windows_of_a_text_beyond_2_to_21_places():
    n = 2**21 + 2000
    h = mix(np.arange(n, dtype=U))
    _, left, m, right, v = c.windows(h, np.array([0, n]), 46)
    assert (v == h[m]).all() and ((left <= m) & (m <= right)).all() and m.max() > 2**21
    for k in np.flatnonzero(m > 2**21 - 100):
        assert h[left[k] : right[k] + 1].min() == h[m[k]]


def test_passages_over_diagonals_that_are_far_apart():
    """Ten words put into the middle of 92, and two halves of 47 words, neither a passage of its own, in the other order; a few words before them are common too."""
    rng = np.random.default_rng(8)
    seq = lambda w: c.shingles(w, np.array([0, len(w)]), c.SIZE)[0]
    new = lambda n: rng.integers(0, 2**63, n).astype(U)
    for _ in range(20):
        p, r, t = new(92), new(94), new(5)
        for x, y, d in ((p, np.concatenate((p[:46], new(10), p[46:])), 0), (r, np.concatenate((r[47:], r[:47])), 47)):
            a, b = seq(np.concatenate((t, new(55), x, new(50)))), seq(np.concatenate((t, new(25), y, new(70))))
            for u, v, low in ((a, b, d - 30), (b, a, 30 - d)):
                got = c.compare(u, v, low, 50)
                assert len(got) == 1 and got[0][3] >= 0.8 and got[0][1] - got[0][0] >= 46
        assert c.compare(seq(np.concatenate((new(60), p[:40], new(60)))), seq(np.concatenate((new(30), p[:40], new(70)))), -30, 50) == []


def test_every_pair_around_a_long_frequent_line_meets(spark):
    """A line of 40 words in 240 texts, in 40 pairs of them within a shared passage of 56 words; all texts have the same surroundings of most windows."""
    rng = random.Random(32)
    wide = lambda n: [f"{w.strip('.,')}{rng.randint(0, 9999)}" for w in prose(rng, n).split()]
    line = wide(40)
    rows = [(k, " ".join([*wide(60), *line, *wide(60)]), "", "", 0, 0, "") for k in range(160)]
    for k in range(40):
        p = [*wide(8), *line, *wide(8)]
        rows += [(1000 + 2 * k + s, " ".join([*wide(30 + 9 * s), *p, *wide(30)]), "", "", 0, 0, "") for s in (0, 1)]
    pairs = {(x.doc_id, x.partner_id) for x in c.passages(frame(spark, rows)).collect()}
    assert pairs == {x for k in range(40) for x in ((1000 + 2 * k, 1001 + 2 * k), (1001 + 2 * k, 1000 + 2 * k))}


def test_pairs_left_by_heads_follow_the_rows_and_none_is_dropped(spark):
    """64 texts with a line of 24 words and nothing else in common make 4 pairs a text at most; 100 with a passage of 60 words, in a cluster each so far, are all joined."""
    from pyspark.sql import functions as F

    rng = random.Random(33)
    wide = lambda n: [f"{w.strip('.,')}{rng.randint(0, 9999)}" for w in prose(rng, n).split()]

    def pairs(n, line):
        docs = frame(spark, [(k, " ".join([*wide(70), *line, *wide(70)]), "", "", 0, 0, "") for k in range(n)]).select("doc_id", "text").withColumn("class", F.xxhash64("text"))
        around = c.window_table(docs).select("key", F.lit(0).cast("long").alias("side"), "class", "window")
        groups = spark.createDataFrame([], "class long, component long")
        return [(r["class"], r.p["class"]) for r in c.rest(docs, docs.select("class", "doc_id"), around, groups).collect()]

    assert len(pairs(64, wide(24))) <= 4 * 64
    found = set(pairs(100, wide(60)))
    assert len({x for p in found for x in p}) == 100 and len(found) <= 800


def test_segments_compared_together_give_what_they_give_one_by_one():
    rng = np.random.default_rng(1)
    pairs = []
    for _ in range(300):
        a, b = (rng.integers(-(2**31), 2**31, rng.integers(0, 400)).astype(np.int32) for _ in "ab")
        low = int(rng.integers(-60, 60))
        for _ in range(3):
            n, i = int(rng.integers(1, 150)), int(rng.integers(0, 300))
            if 0 <= i + low and i + low + n <= len(b) and i + n <= len(a):
                b[i + low : i + low + n] = a[i : i + n]
                b[i + low + n // 2] ^= 1
        pairs.append((a, b, low))
    at = lambda z: np.concatenate(([0], np.cumsum([len(x) for x in z])))
    xs, ys, lows = zip(*pairs, strict=True)
    rows, left = c.level(np.concatenate(xs), at(xs), np.concatenate(ys), at(ys), np.array(lows), 50)
    got = defaultdict(list)
    for k, *r in zip(*(x.tolist() for x in rows), strict=True):
        got[k].append(tuple(r))
    assert len(got) > 50
    for k, p in enumerate(pairs):
        assert k in left or got[k] == c.compare(*p, 50)
    none = np.zeros(0, np.int32)
    assert c.level(none, np.zeros(3, np.int64), none, np.zeros(3, np.int64), np.zeros(2, np.int64), 50)[1].tolist() == []


def test_pair_whose_shingles_all_stand_in_many_texts_is_found(spark):
    """Two texts with a line of 30 words, another word, and 19 words more, whose first twelve 70 texts have after that line, and whose last twelve 70 others."""
    rng = random.Random(35)
    wide = lambda n: [f"{w.strip('.,')}{rng.randint(0, 9999)}" for w in prose(rng, n).split()]
    line, tail = wide(30), wide(19)
    held = [tail[:12]] * 70 + [tail[7:]] * 70 + [tail] * 2
    rows = [(k, " ".join([*wide(40), *line, f"gap{k}", *([] if t[0] == tail[0] else wide(7)), *t, *wide(40)]), "", "", 0, 0, "") for k, t in enumerate(held)]
    found = c.passages(frame(spark, rows)).collect()
    assert {(r.doc_id, r.partner_id) for r in found} == {(140, 141), (141, 140)} and {r.cluster_id for r in found} == {140}
