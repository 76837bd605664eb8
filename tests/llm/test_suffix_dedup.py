import hashlib
from collections import Counter

import numpy as np
import pytest
from helpers import corpus, frame

from tidewake.llm import suffix_dedup
from tidewake.llm.induced_sort import RunQueue, repeated_starts, sort_suffixes


def brute(texts, length):
    count = Counter(b[k : k + length] for b in texts for k in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("memory", [0, 200, 10**9])
def test_suffixes_in_order(memory):
    rng = np.random.default_rng(memory + 1)
    for _ in range(120):
        s = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 60)), 0).astype(np.int32)
        assert sort_suffixes(s, memory=memory).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_queue_spills_and_keeps_order():
    q = RunQueue(memory=16)
    q.push(3, np.arange(2))
    q.push(3, np.arange(5, 9))
    q.push(1, np.arange(3))
    assert q.file is not None and q.pop(3).tolist() == [0, 1, 5, 6, 7, 8] and q.pop(3).tolist() == []
    q.close()


def test_repeated_starts():
    rng = np.random.default_rng(5)
    for _ in range(100):
        size = int(rng.integers(2, 6))
        texts = [bytes(rng.integers(97, 99, rng.integers(0, 30)).tolist()) for _ in range(rng.integers(1, 6))]
        starts = [max(0, len(x) - size + 1) for x in texts]
        count = Counter(x[i : i + size] for x, n in zip(texts, starts, strict=True) for i in range(n))
        assert [g.tolist() for g in repeated_starts(texts, starts, size)] == [[count[x[i : i + size]] > 1 for i in range(n)] for x, n in zip(texts, starts, strict=True)]


@pytest.mark.parametrize(("hot", "share"), [(4096, 256), (1, 256), (1, 10**6), (3, 10**6)])
def test_equals_brute_force(spark, monkeypatch, hot, share):
    """Also overlaps, the same document, copies, nulls, a repeated row, owners dealt by single strings, and keys that are taken apart for their rows."""
    monkeypatch.setattr(suffix_dedup, "SHARE", share)
    rows = corpus() + [(900, "ab" * 300, "", "", 0, 0, ""), (901, "x" * 100 + corpus()[5][1][:500], "", "", 0, 0, "")]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(frame(spark, rows), 120, 20, hot, shard=2000, memory=1000).collect())
    assert got == sorted((r[0], *b) for r, b in zip(rows, brute([(r[1] or "").encode() for r in rows], 120), strict=True))


def test_empty_table_and_kept_bytes(spark):
    assert suffix_dedup.dedup(frame(spark, [])).count() == 0
    r = suffix_dedup.dedup(frame(spark, corpus()[:3]), with_text=True).collect()
    assert all(hashlib.sha256(x.kept).hexdigest() == x.kept_sha256 for x in r)
