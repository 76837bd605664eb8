import collections
import hashlib
import random

import pytest
from helpers import SCHEMA, corpus, frame, prose

from tidewake.llm import alignment
from tidewake.llm.token_counts import encoder

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute(rows):
    """The definition: byte ranges of all tokens, cut where both end, linked where they overlap."""
    import sentencepiece
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    out, count = [], collections.Counter()
    for i, t in rows:
        a = ta.encode(" " + t, add_special_tokens=False).ids if t else []
        b = tb.encode(t) if t else []
        parts = [[bytes(byte[c] for c in ta.id_to_token(x)) for x in a], [bytes([int(tb.id_to_piece(x)[3:5], 16)]) if tb.is_byte(x) else tb.id_to_piece(x).replace("▁", " ").encode() for x in b]]
        if t and any(b"".join(p) != (" " + t).encode() for p in parts):
            a, b, parts = [], [], [[], []]
        ranges = []
        for p in parts:
            at = 0
            ranges.append([(at, at := at + len(x)) for x in p])
        ends = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        groups = [",".join(str(x) for x, r in zip(a, ranges[0], strict=True) if lo < r[1] <= hi) + "|" + ",".join(str(y) for y, r in zip(b, ranges[1], strict=True) if lo < r[1] <= hi) for lo, hi in zip([0, *ends], ends, strict=False)]
        links = [(x, y) for x, r in zip(a, ranges[0], strict=True) for y, q in zip(b, ranges[1], strict=True) if r[0] < q[1] and q[0] < r[1]]
        count.update(set(links))
        out.append((i, a, b, groups, links))
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [(i, len(a), len(b), len(g), len(v), sum(count[z] == best[z[0]] for z in v), sum(count[z] for z in v), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for i, a, b, g, v in out]


ODD = ["▁marked", "a  b\n\n\tc  ", "<|endoftext|> and <s> </s>", "<0x41> stays text", "don't we'll  x" * 9, "no-space" * 300, "\x00\x01", "ﬁ é é", "  leading", "漢字かな混じり文。" * 20, "😀👍🏽" * 30, " "]


@pytest.mark.parametrize("block", [1, 4000, alignment.BLOCK])
def test_equal_to_brute_force(spark, block):
    rows = [r for r in corpus() if len(r[1] or "") < 4000]
    rows += [(500 + k, t, "en", "a", 0, 0, "") for k, t in enumerate(ODD)]
    got = sorted(map(tuple, alignment.alignment_digest(frame(spark, rows), A, B, block=block).collect()))
    assert got == sorted(brute([(r[0], r[1]) for r in rows]))


def test_groups_and_pairs_are_real_outputs(spark):
    rng = random.Random(4)
    text = prose(rng, 60) + " naïve 漢 <|endoftext|>"
    row = alignment.alignments(frame(spark, [(1, text, "en", "a", 0, 0, ""), (2, None, "en", "a", 0, 0, "")]), A, B).orderBy("doc_id").collect()
    t = alignment._Tokenizers(A, B)
    a, b = t.encode(text)
    groups = [g.split("|") for g in row[0].groups.split(";")]
    ids = lambda k: [int(x) for g in groups for x in g[k].split(",")]
    assert (ids(0), ids(1)) == (a, b) and (row[0].n_a, row[0].n_b) == (len(a), len(b))
    for g in groups:  # each group is the same bytes by either tokenizer
        assert b"".join(t.bytes_a[int(x)] for x in g[0].split(",")) == b"".join(t.bytes_b[int(x)] for x in g[1].split(","))
    assert (row[1].n_a, row[1].groups, row[1].pairs) == (0, "", [])


def test_windows_are_aligned_once_and_forgetting_changes_nothing(monkeypatch):
    m = alignment.Aligner(A, B)
    texts = ["the cat sat on the mat " * 50] * 4
    first = m.align(texts)
    assert len(first.window) > 1000 and len(m.many) < 20
    monkeypatch.setattr(alignment, "MEMO", 1)
    again = m.align(texts)
    assert first.n_links.tolist() == again.n_links.tolist() and len(m.many) < 20


def test_row_groups_of_blocks_stay_small(spark):
    """A task's blocks aren't held until it ends: the writer asks for its size after each row, not after 100."""
    import glob

    import pyarrow.parquet as pq

    rows = spark.range(0, 40, 1, 1).selectExpr("id", "transform(sequence(1, 65536), x -> xxhash64(x, id)) AS a")  # half a megabyte each
    path = alignment.cut(rows, "blocks-test", 4 << 20).inputFiles()[0].removeprefix("file://")
    found = [pq.ParquetFile(f).metadata for f in glob.glob(path)]
    assert [m.num_rows for m in found] == [40] and max(m.row_group(k).num_rows for m in found for k in range(m.num_row_groups)) <= 16


def test_windows_stand_for_themselves():
    """Texts cut at anchors have the ids and groups of whole texts, also where a window's own tokens differ from its characters."""
    m, rng = alignment.Aligner(A, B), random.Random(8)
    alphabet = ["a", "the", "'s", "é", " ", " ", "\n", "\t", "▁", "漢", "\xa0", "1", ".", "<|endoftext|>", "\x1c"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    r = m.align(texts)
    for k, x in enumerate(texts):
        a, b = m.t.encode(x)
        assert (r.n_a[k], r.n_b[k]) == (len(a), len(b))
        groups = [g.split("|") for g in m.text_groups(r, k).split(";") if g]
        assert [",".join(g[i] for g in groups) for i in (0, 1)] == [",".join(map(str, y)) for y in (a, b)]


def test_fast_encoder_gives_the_librarys_ids():
    t = alignment._Tokenizers(A, B)
    rng = random.Random(6)
    alphabet = "ab cd'\n\t.,!?éßø1234  <|>" + "s"
    for _ in range(3000):
        x = " " + "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40)))
        if encoder(A).plain(x):
            assert t.plain.fast.encode_ordinary(x) == t.a.encode(x, add_special_tokens=False).ids


def test_empty_table_and_rows_without_ids(spark):
    assert alignment.alignment_digest(spark.createDataFrame([], SCHEMA), A, B).collect() == []
    got = alignment.alignment_digest(frame(spark, [(None, "one two", "en", "a", 0, 0, ""), (3, "", "en", "a", 0, 0, "")]), A, B).collect()
    assert sorted((r.doc_id or 0, r.n_a > 0, r.groups_sha256 == "") for r in got) == [(0, True, False), (3, False, True)]
