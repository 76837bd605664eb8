"""Alignment of two tokenizers' ids by anchors at white space.

Each text is encoded by a byte-level BPE (A, with a space before the text) and by sentencepiece (B, which adds that space). A single space between two
characters that aren't white space is an anchor: A's pattern begins a pre-token there, which never looks back, and no piece of B has its mark for a space
behind another character (the vocabulary is asked), so no merge of either crosses it, and what follows is encoded as if it stood alone. Between two anchors lies a
window; its ids by A and B and their alignment depend on its own characters alone. Windows of ordinary prose repeat all the time, so each is encoded and aligned
once and remembered by its text, and the rest is arithmetic on arrays. With other kinds of tokenizers a whole text is one window.

In a window, offsets at which both tokens end cut groups, and tokens whose byte ranges overlap are linked. How many documents hold an id pair is
counted over the corpus: texts are taken in blocks of BLOCK bytes, a block sends each of its pairs once, with the number of its documents that
hold it, and gets its count back once. So the most frequent pair has a row a block, however many documents have it, and documents
themselves don't move.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .token_counts import encoder

BLOCK = 4 << 20  # bytes of text in a block, about
MEMO = 1 << 18  # windows remembered by a worker
ROW_GROUP = 16 << 20  # bytes of blocks that a task buffers until it writes them, about
#: Anchors: a space between two characters of which neither is white space.
_ANCHOR = re.compile(r" (?<=\S )(?=\S)")


class _Tokenizers:
    """Ids of texts by both tokenizers, and what each id stands for in bytes."""

    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.plain = encoder(a)
        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow from 256 on
        byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.lengths_a, self.lengths_b = self.size_a.tolist(), self.size_b.tolist()
        self.named = [str(k) for k in range(max(len(self.bytes_a), len(self.bytes_b)))]
        apart = self.plain.by_pieces and not any(" " in self.b.id_to_piece(i).replace("▁", " ").lstrip(" ") for i in range(self.b.get_piece_size()))
        self.windows = _ANCHOR.split if apart and self._identity() else lambda text: [text]

    def _identity(self) -> bool:
        """Whether B changes no character before it looks for pieces."""
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto.FromString(self.b.serialized_model_proto())
        return not (spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix) and spec.normalizer_spec.add_dummy_prefix

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids by A and by B; none if the text is empty or the ids' bytes aren't those of a space and the text."""
        if not text:
            return [], []
        whole = " " + text
        a = self.plain.fast.encode_ordinary(whole) if self.plain.fast and self.plain.plain(whole) else self.a.encode(whole, add_special_tokens=False).ids
        b, data = self.b.encode(text), whole.encode()
        same = b"".join(map(self.bytes_a.__getitem__, a)) == data and b"".join(map(self.bytes_b.__getitem__, b)) == data
        return (a, b) if same else ([], [])


class Aligned(NamedTuple):
    """What a block's texts have. For each text: ids, windows from `first` on (one more entry), groups, links. Of each (text, pair): times."""

    n_a: np.ndarray
    n_b: np.ndarray
    first: np.ndarray
    window: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    text: np.ndarray
    pair: np.ndarray
    times: np.ndarray


class Aligner:
    """Aligns texts; remembers windows."""

    def __init__(self, a: str, b: str):
        self.t = _Tokenizers(a, b)
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.numbers: dict[int, int] = {}
        self.groups: list[str] = []
        self.pairs, self.linked = array("q"), array("q")  # a << 32 | b by number; numbers of each window's links
        self.to, self.many = array("q", [0]), array("q")  # where a window's links end; how many groups it has
        self.ids_a, self.ids_b = array("q"), array("q")  # how many ids it has

    def _learn(self, parts: list[str]) -> None:
        """Encode, align and remember windows: in one string where the space between two is an anchor. A window's number is -1 if its ids' bytes aren't its own."""
        if len(parts) > 1:
            loose = [x for x in parts if x[:1].isspace() or x[-1:].isspace()]
            inner = [x for x in parts if x not in loose] if loose else parts
            a, b = self.t.encode(" ".join(inner))
            if a:
                self._align(inner, a, b)
            parts = loose if a else parts
        for x in parts:
            a, b = self.t.encode(x)
            if a:
                self._align([x], a, b)
            else:
                self.seen[x] = -1

    def _align(self, parts: list[str], a: list[int], b: list[int]) -> None:
        """Align windows that have these ids, one after another."""
        size_a, size_b, named, numbers, linked, seen = self.t.lengths_a, self.t.lengths_b, self.t.named, self.numbers, self.linked, self.seen
        i = j = x = y = end = 0
        for part in parts:
            end += len(part) + 1 if part.isascii() else len(part.encode()) + 1
            from_a = begin_a = i
            from_b = begin_b = j
            text = []
            x, y = x + size_a[a[i]], y + size_b[b[j]]
            while True:
                pair = a[i] << 32 | b[j]
                number = numbers.get(pair)
                if number is None:
                    number = numbers[pair] = len(self.pairs)
                    self.pairs.append(pair)
                linked.append(number)
                if x == y:
                    text.append(f"{named[a[i]] if i == from_a else ','.join([named[k] for k in a[from_a : i + 1]])}|{named[b[j]] if j == from_b else ','.join([named[k] for k in b[from_b : j + 1]])}")
                    i, j = i + 1, j + 1
                    if x == end:
                        break
                    from_a, from_b = i, j
                    x, y = x + size_a[a[i]], y + size_b[b[j]]
                elif x < y:
                    i += 1
                    x += size_a[a[i]]
                else:
                    j += 1
                    y += size_b[b[j]]
            seen[part] = len(self.many)
            self.groups.append(";".join(text))
            self.to.append(len(linked))
            self.many.append(len(text))
            self.ids_a.append(i - begin_a)
            self.ids_b.append(j - begin_b)

    def align(self, texts: list[str | None]) -> Aligned:
        if len(self.many) > MEMO or len(self.linked) > 16 * MEMO:
            self.forget()
        get, split, found, first = self.seen.get, self.t.windows, array("q"), [0]
        for x in texts:
            parts = split(x) if x else []
            numbers = list(map(get, parts))
            if None in numbers:
                self._learn(list(dict.fromkeys(p for p, n in zip(parts, numbers, strict=True) if n is None)))
                numbers = list(map(get, parts))
            if -1 not in numbers:  # else the text has no tokens
                found.extend(numbers)
            first.append(len(found))
        window, first = (np.array(z, np.int64) for z in (found, first))
        n_a, n_b = (np.diff(np.concatenate(([0], np.cumsum(np.array(z, np.int64)[window])))[first]) for z in (self.ids_a, self.ids_b))
        to, many, linked = (np.frombuffer(z, np.int64) if len(z) else np.zeros(0, np.int64) for z in (self.to, self.many, self.linked))
        count = to[window + 1] - to[window]
        groups, links = (np.diff(np.concatenate(([0], np.cumsum(z)))[first]) for z in (many[window], count))
        number = linked[np.repeat(to[window] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
        code, times = np.unique(np.repeat(np.arange(len(texts)), links) * max(1, len(self.pairs)) + number, return_counts=True)
        text, pair = np.divmod(code, max(1, len(self.pairs)))
        return Aligned(n_a, n_b, first, window, groups, links, text, np.array(self.pairs, np.int64)[pair], times)

    def text_groups(self, r: Aligned, k: int) -> str:
        """The groups of text k: ids of A, |, ids of B; groups are parted by semicolons."""
        return ";".join(map(self.groups.__getitem__, r.window[r.first[k] : r.first[k + 1]].tolist()))


@functools.cache
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def _lists(at: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[int | None], list[str | None]]]:
    """doc_id and text of the batches' rows, in blocks of `most` bytes of text, about."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, x in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            ids.append(i)
            texts.append(x)
            size += len(x or "") + 8
            if size >= most:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def alignments(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, groups, pairs (array of a, b, times) for each row of docs (doc_id, text).

    a: a file of the tokenizers library (byte-level BPE), b: one of sentencepiece. groups: `a1,a2|b1;a3|b2,b3`, ids in order, cut where tokens of both
    end. pairs: linked ids, with how many times. Texts that are null or empty, or whose tokens' bytes aren't those of a space and the text
    (such as those with the mark that B writes spaces as), have no tokens. Repeated rows give repeated results; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = aligner(a, b)
        for ids, texts in _gathered(batches, BLOCK):
            r = m.align(texts)
            pairs = pa.StructArray.from_arrays([pa.array(r.pair >> 32, pa.int32()), pa.array(r.pair & 0xFFFFFFFF, pa.int32()), pa.array(r.times, pa.int64())], ["a", "b", "times"])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(r.n_a), pa.array(r.n_b), pa.array([m.text_groups(r, k) for k in range(len(ids))]), _lists(np.searchsorted(r.text, np.arange(len(ids) + 1)), pairs)], ["doc_id", "n_a", "n_b", "groups", "pairs"])

    return _read(docs).mapInArrow(run, "doc_id long, n_a long, n_b long, groups string, pairs array<struct<a: int, b: int, times: long>>")


_BLOCK = "block long, doc_id array<long>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<int>, sha array<string>, pair array<long>, docs array<int>, at array<int>, use array<int>, times array<int>"


def _blocks(docs: DataFrame, a: str, b: str, size: int) -> DataFrame:
    """A row a block: its texts' numbers; its pairs, in how many of its texts each is; and of text k its pairs use[at[k]:at[k + 1]] with times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, base = aligner(a, b), TaskContext.get().partitionId() << 32
        names = [x.split(" ")[0] for x in _BLOCK.split(", ")]
        for k, (ids, texts) in enumerate(_gathered(batches, size)):
            r = m.align(texts)
            pair, use, docs_ = np.unique(r.pair, return_inverse=True, return_counts=True)
            sha = [hashlib.sha256(m.text_groups(r, i).encode()).hexdigest() if n else "" for i, n in enumerate(r.n_a.tolist())]
            values = [pa.array(ids, pa.int64()), *(pa.array(x, pa.int32()) for x in (r.n_a, r.n_b, r.n_groups, r.n_links)), pa.array(sha, pa.string()), pa.array(pair), *(pa.array(x, pa.int32()) for x in (docs_, np.searchsorted(r.text, np.arange(len(ids) + 1)), use, r.times))]
            yield pa.RecordBatch.from_arrays([pa.array([base + k]), *(_lists([0, len(v)], v) for v in values)], names)

    return _read(docs).mapInArrow(run, _BLOCK)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair (a << 32 | b), n, best: in how many texts each pair is linked, and the highest such number of its A id. At most B's vocabulary a pair's A id."""
    counts = blocks.select(F.inline(F.arrays_zip("pair", "docs"))).groupBy("pair").agg(F.sum("docs").alias("n"))
    a = F.shiftright("pair", 32)
    best = counts.groupBy(a.alias("_a")).agg(F.max("n").alias("best"))
    return counts.join(best, a == F.col("_a")).select("pair", "n", "best")


def alignment_digest(docs: DataFrame, a: str, b: str, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs (doc_id, text); see alignments() for rows without tokens.

    n_best: links whose pair is in as many texts as any pair of its A id. count_sum: over links, in how many texts their pair is. groups_sha256: of
    alignments()' groups, empty without tokens.
    """
    blocks = cut(_blocks(docs, a, b, block), "alignment-blocks", ROW_GROUP)
    told = blocks.select("block", F.posexplode("pair").alias("k", "pair")).join(pair_counts(blocks), "pair")
    told = told.groupBy("block").agg(F.collect_list(F.struct("k", "n", (F.col("n") == F.col("best")).alias("top"))).alias("told"))  # a block's own pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                of = lambda c, row=row, batch=batch: batch.column(c)[row].values
                ids, at = of("doc_id"), of("at").to_numpy()
                if batch.column("told")[row].is_valid:
                    k, n, top = of("told").flatten()
                    count, best = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
                    count[k.to_numpy()], best[k.to_numpy()] = n.to_numpy(), top.to_numpy(zero_copy_only=False)
                    use, times = of("use").to_numpy(), of("times").to_numpy()
                    sums = [np.diff(np.concatenate(([0], np.cumsum(x[use] * times)))[at]) for x in (best, count)]
                else:
                    sums = [np.zeros(len(ids), np.int64)] * 2
                yield pa.RecordBatch.from_arrays([ids, *(of(c).cast(pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), *(pa.array(x) for x in sums), of("sha")], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return blocks.drop("pair", "docs").join(told, "block", "left").mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
