"""Token counts by overlap resynchronisation.

A text is cut into chunks that overlap. Each chunk is encoded by itself, with the offsets at which its pre-tokens (the pieces within
which merges happen) begin. Two neighbours are spliced where a pre-token begins at the same character in both. Such a place is a
proven boundary if it lies far enough before the left chunk's end: the splitting pattern reads left to right, never looks back, and
looks ahead of a piece by fewer characters than GUARD, and so does the search for special strings; left of the place the left chunk
has what the whole text gives, right of it the right chunk has. If no such place exists (one piece longer than the overlap), the
left chunk grows and the overlap is widened until there is one, at worst to the text's end.

A text of one chunk needs no splice. Where the file is a byte-level BPE whose ids follow its merges, chunks are encoded by a faster
public encoder (tiktoken) from the same file's vocabulary. A chunk with characters outside the ranges on which the pattern was compared
with the library's, or with a special string, goes to the library itself.
"""

from __future__ import annotations

import functools
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 12  # characters of a chunk; texts of more are spliced
OVERLAP = 512  # characters that neighbours share at first
GUARD = 32  # characters before a chunk's end in which boundaries aren't trusted: over the pattern's look-ahead and any special string
MEMO = 1 << 18  # pieces remembered by a worker

#: The split pattern of byte-level BPE, as published with it.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters on which the pattern is known to act as the library's does.
_KNOWN = r"[^\t\n\r\x20-\x7E¡-¬®-ſ]"


def _same_merges(model: dict):
    """An encoder by ranks with the model's vocabulary, or None if its ids don't follow its merges."""
    import tiktoken

    vocab, merges = model.get("vocab", {}), [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    if model.get("type") != "BPE" or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    ids = [vocab.get(a + b, -1) for a, b in merges]
    if any(x >= y for x, y in zip(ids, ids[1:], strict=False)) or not ids or ids[0] < 0:
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow from 256 on
    char = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(char[c] for c in w): i for w, i in vocab.items() if all(c in char for c in w) and (len(w) == 1 or i >= ids[0])}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks={w: i for w, i in ranks.items() if i <= ids[-1]}, special_tokens={})


class Encoder:
    """Pre-token starts and token counts of a string, by the tokenizers library."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        spec = json.loads(self.library.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.by_pieces = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.find, self.odd, self.memo = regex.compile(SPLIT).findall, regex.compile(_KNOWN).search, {}
        self.fast = self.by_pieces and _same_merges(spec["model"])
        if any(len(x) >= GUARD for x in self.special):
            raise ValueError("a special string is longer than GUARD")

    def _count(self, piece: str) -> int:
        n = self.memo.get(piece)
        if n is None:
            n = len(self.library.encode(piece, add_special_tokens=False).ids)
            if len(self.memo) < MEMO:
                self.memo[piece] = n
        return n

    def plain(self, text: str) -> bool:
        return self.by_pieces and not self.odd(text) and not any(x in text for x in self.special)

    def count(self, text: str) -> int:
        if not self.plain(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        return len(self.fast.encode_ordinary(text)) if self.fast else sum(map(self._count, self.find(text)))

    def offsets(self, text: str) -> tuple[list[int], list[int]]:
        """Where each pre-token begins, and how many tokens come before it; both with an entry for the end."""
        if self.plain(text):
            found = self.find(text)
            return list(accumulate(map(len, found), initial=0)), list(accumulate(map(self._count, found), initial=0))
        e = self.library.encode(text, add_special_tokens=False)
        starts, before, last = [], [], object()
        for k, (word, (a, _)) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
            if word is None or word != last:
                while a > 0 and starts and self.by_pieces and text[a - 1] == " " and a - 1 >= e.offsets[k - 1][1]:
                    a -= 1  # the library leaves the space before a word out of its offsets
                    break
                starts.append(a)
                before.append(k)
            last = word if word is not None else object()
        return [*starts, len(text)], [*before, len(e.ids)]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def count_tokens(text: str, e: Encoder, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens the library gives for the whole text."""
    if len(text) <= chunk:
        return e.count(text)
    total, begin, known = 0, 0, 0  # tokens left of `known`, a proven boundary; begin: of the left chunk
    end = min(begin + chunk, len(text))
    starts, before = e.offsets(text[begin:end])
    while end < len(text):
        shared = overlap
        while True:
            at = max(known, end - shared)
            nxt = min(at + max(chunk, 2 * shared), len(text))
            starts2, before2 = e.offsets(text[at:nxt])
            lo, hi = bisect_left(starts, max(at, known) - begin), bisect_right(starts, end - GUARD - begin)
            right = set(starts2[:-1])
            place = next((starts[k] + begin for k in range(hi - 1, lo - 1, -1) if starts[k] + begin - at in right and (starts[k] + begin > known or at == known)), None)
            if place is not None and (place > known or end == len(text)):
                break
            if at == known and place is None or at == known and place == known:  # one piece fills all that is left of the left chunk: it grows
                end = min(begin + 2 * (end - begin), len(text))  # doubled, so a long piece is encoded a few times its length
                starts, before = e.offsets(text[begin:end])
                if end == len(text):
                    place = None
                    break
            shared *= 2
        if place is None:
            break
        total += before[bisect_left(starts, place - begin)] - before[bisect_left(starts, known - begin)]
        starts, before, begin, end, known = starts2, before2, at, nxt, place
    return total + before[-1] - before[bisect_left(starts, known - begin)]


def token_counts(docs: DataFrame, path: str, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text; other columns are not read).

    Null and empty texts have no tokens; repeated rows give repeated results; an empty table gives no rows. No shuffle: rows are
    counted where they are read, and a worker holds one batch and the offsets of two chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            texts = b.column("text")
            n = [count_tokens(t, e, chunk, overlap) if t else 0 for t in texts.to_pylist()]
            size = pa.compute.fill_null(pa.compute.binary_length(texts.cast(pa.large_binary())), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
