import random

import numpy as np
import pytest
from helpers import SCHEMA, corpus, frame, prose, words

from tidewake.llm import simhash
from tidewake.llm.textnum import U


def brute(rows):
    """Fingerprints and components by the definition."""
    from xxhash import xxh64_intdigest

    fp = {}
    for i, t in rows:
        w = words(t)
        grams = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [xxh64_intdigest(g.encode(), 42) for g in grams]
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(fp)
    of = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (fp[i] ^ fp[j]).bit_count() <= 4 and of[j] < of[i]:
                    of[i], changed = of[j], True
    return {i: (f"{fp[i]:016x}", of[i]) for i in ids}


def test_equal_to_brute_force(spark):
    rows = corpus()
    got = simhash.near_duplicates(frame(spark)).collect()
    want = brute([(r[0], r[1]) for r in rows])
    assert len(got) == len(rows)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want


def test_the_code_is_perfect():
    rng = np.random.default_rng(1)
    code = np.unique(simhash.nearest(np.arange(1 << 23, dtype=np.int64)), return_counts=True)[1]
    assert len(code) == 4096 and (code == 2048).all()
    word = rng.integers(0, 1 << 23, 2000)
    near = simhash.nearest(word)
    for k in rng.integers(0, 23, 5):
        flipped = simhash.indices(word ^ (1 << k), 23)
        assert all(n in set(i[u]) for n, i, u in zip(near, *flipped, strict=True))


def test_links_share_a_key():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.int64).view(np.uint64) * U(2) + rng.integers(0, 2, 3000).astype(U)
    for bits in range(5):
        b = a.copy()
        for k in range(len(b)):
            for x in rng.choice(64, bits, replace=False):
                b[k] ^= U(1) << U(x)
        (ka, na), (kb, nb) = simhash.keys(a), simhash.keys(b)
        ca, cb = np.concatenate(([0], np.cumsum(na))), np.concatenate(([0], np.cumsum(nb)))
        assert all(set(ka[ca[i] : ca[i + 1]]) & set(kb[cb[i] : cb[i + 1]]) for i in range(len(a)))
        assert na.max() <= 252


@pytest.mark.parametrize("seed", range(3))
def test_components_of_dense_and_drifting_groups(spark, monkeypatch, seed):
    monkeypatch.setattr(simhash, "SALT", 4)  # many salts
    rng = random.Random(seed)
    fps = set()
    for _ in range(8):
        now = rng.getrandbits(64)
        for _ in range(40):
            drift = now
            for _ in range(rng.randint(1, 6)):
                drift ^= 1 << rng.randrange(64)
            fps.add(drift)
            now = drift if rng.random() < 0.3 else now
    fps = sorted(fps)
    of = {x: x for x in fps}

    def top(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[i + 1 :]:
            if (x ^ y).bit_count() <= 4:
                a, b = top(x), top(y)
                of[max(a, b)] = min(a, b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {r.fp: r.component for r in simhash.linked(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()}
    groups = {}
    for x in fps:
        groups.setdefault(top(x), set()).add(signed(x))
    found = {}
    for x, c in got.items():
        found.setdefault(c, set()).add(x)
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_long_texts_count_in_chunks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(k, prose(rng, n), "en", "a", 0, 0, "") for k, n in enumerate((1, 3, 500, 4000, 12))]
    want = {r.doc_id: r.fp for r in simhash.fingerprints(frame(spark, rows)).collect()}
    import pyarrow as pa

    monkeypatch.setattr(simhash, "CHUNK", 100)
    batch = pa.RecordBatch.from_pydict({"text": [r[1] for r in rows]})
    assert simhash.fingerprint_batch(batch).view(np.int64).tolist() == [want[k] for k in range(len(rows))]


def test_edges(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "a b c d e", "en", "a", 0, 0, ""), (None, None, "en", "a", 0, 0, ""), (7, "", "en", "a", 0, 0, ""), (7, "A b\tc d E", "en", "a", 0, 0, "")]
    got = sorted((r.doc_id or -1, r.fingerprint == "0" * 16, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect())
    assert got == [(-1, False, 7), (-1, True, 7), (7, False, 7), (7, True, 7)]


def test_no_table_that_grows_is_broadcast(spark, monkeypatch):
    """The plans of all steps, the components' among them, hold no broadcast: such a table would be built whole on the driver."""
    from tidewake.llm import graph

    plans = []

    def told(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, name)

    cut = simhash.cut
    monkeypatch.setattr(simhash, "cut", told)
    monkeypatch.setattr(graph, "cut", told)
    last = simhash.near_duplicates(frame(spark))
    plans.append(last._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8 and not any("Broadcast" in p for p in plans)
