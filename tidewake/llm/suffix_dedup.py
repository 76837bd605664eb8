"""Suffix-array dedup: remove every byte that a string of LENGTH bytes covers which also begins elsewhere.

1. Equal texts are one class; a class of two rows or more is repeated whole.
2. Every string of LENGTH bytes has an owner: the place in it with the least hash of GRAM bytes. Equal strings have owners with equal hashes, so
   only texts around owners' hashes that occur twice are looked at again. The strings of one owner begin in one run of places; the run's
   bytes are its stretch. Stretches are dealt to tasks by the owner's hash.
3. Equal stretches are counted first (partly before the shuffle): what they hold is repeated. The rest go through the external induced
   sort of induced_sort.py, shard by shard of about SHARD bytes of whole owner groups, with queues that spill to disk; neighbours in suffix
   order with LENGTH bytes in common are repeats.
4. An owner's hash with more than HOT different stretches (a passage that very many texts share, in different surroundings) would be one
   large group. Its strings are counted one by one by two 64-bit fingerprints instead, partly before the shuffle, so no task gets them all.
5. Keys with more than a share of 1 / SHARE of a table's rows are SHARE at most. Such owners are known to repeat, so their rows need no join by
   owner; what is found for such stretches is broadcast. No exchange sends one key's rows to one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut
from .compact_windows import sliding_least
from .induced_sort import MEMORY, repeated_starts
from .textnum import U, gram_hashes, mix, pieces, raw

LENGTH = 400
GRAM = 64
HOT = 4096
SHARD = 2 << 20
SHARE = 256


def owners(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, the owner's hash, and the first and last place of the strings of `length` bytes that it owns; places count within the text."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.view(U), none, none
    h = gram_hashes(data, gram)
    bits = max(28, len(h).bit_length())
    packed = (h >> U(bits) << U(bits)) | np.arange(len(h), dtype=U)
    low = sliding_least(packed, length - gram + 1)  # for each string, its leftmost least gram
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    own = text[: len(low)] == text[length - 1 :]
    new = own.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~own[:-1]
    first = np.flatnonzero(new)
    stop = np.append(np.flatnonzero(~own[1:] | (low[1:] != low[:-1])), len(low) - 1)
    last = stop[np.searchsorted(stop, first)]
    doc = text[first]
    return doc, h[(low[first] & U((1 << bits) - 1)).astype(np.int64)], first - at[doc], last - at[doc]


def _owner_table(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for b in pieces(batch, "text"):
                named = b.column("class").to_numpy()
                d, h, x, y = owners(*raw(b.column("text")), length, gram)
                fresh = np.zeros(len(named), bool)
                for k, c in enumerate(named.tolist()):
                    if c not in seen:
                        seen.add(c)
                        fresh[k] = True
                use = fresh[d]
                yield pa.RecordBatch.from_arrays([pa.array(h[use].view(np.int64)), pa.array(named[d[use]]), pa.array(x[use]), pa.array(y[use])], ["h", "class", "first", "last"])

    return docs.select("class", "text").mapInArrow(run, "h long, class long, first long, last long")


def _runs(flag: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of True."""
    e = np.flatnonzero(np.diff(np.concatenate(([0], flag.view(np.int8), [0]))))
    return list(zip(e[::2].tolist(), (e[1::2] - 1).tolist(), strict=True))


_SPANS = "h long, f1 long, f2 long, spans array<struct<x:long,y:long>>"
_SPANS_ARROW = pa.schema([("h", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("spans", pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())])))])


def _sorted_spans(mixed: DataFrame, length: int, shard: int, memory: int) -> DataFrame:
    """For each stretch, the runs of places in it that begin repeated strings. mixed is dealt by owner hash and sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            hits = repeated_starts([x[4] for x in held], [x[5] for x in held], length, memory)
            out = [(h, f1, f2, [{"x": a, "y": b} for a, b in _runs(hit | (n > 1))]) for (h, f1, f2, n, _, _), hit in zip(held, hits, strict=True)]
            return pa.RecordBatch.from_pylist([dict(zip(_SPANS_ARROW.names, r, strict=True)) for r in out if r[3]], schema=_SPANS_ARROW)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "f1", "f2", "n", "stretch", "starts")), strict=True):
                if size > shard and row[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield flush()

    return mixed.select("h", "f1", "f2", "n", "stretch", "starts").mapInArrow(run, _SPANS)


def _hot_spans(hot: DataFrame, length: int) -> DataFrame:
    """The same by counting fingerprints of single strings, for stretches of owners that very many stretches share."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                b = batch.slice(k, 256)
                data, at = raw(b.column("stretch"))
                n = b.column("starts").to_numpy()
                row = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                where = at[row] + place
                one = gram_hashes(data, length)[where]
                half = gram_hashes(data, length // 2)
                two = mix(half[where] * U(3) + half[where + length - length // 2])
                fixed = [b.column(c).take(pa.array(row)) for c in ("h", "f1", "f2", "n")]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(place), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["h", "f1", "f2", "n", "place", "s1", "s2"])

    s = hot.select("h", "f1", "f2", "n", "stretch", "starts").mapInArrow(strings, "h long, f1 long, f2 long, n long, place long, s1 long, s2 long")
    twice = s.groupBy("s1", "s2").agg(F.sum("n").alias("all")).where("all > 1").select("s1", "s2")
    found = s.join(twice, ["s1", "s2"], "left_semi").groupBy("h", "f1", "f2").agg(F.collect_list(F.struct(F.col("place").alias("x"), F.col("place").alias("y"))).alias("spans"))
    return found.select("h", "f1", "f2", "spans")


def _frequent(counts: DataFrame, count: str, keys: list[str], least: int) -> list[tuple]:
    """Keys whose count is over `least` and over 1 / SHARE of the sum of counts, so SHARE keys at most."""
    total = counts.agg(F.sum(count)).first()[0] or 0
    return [tuple(r) for r in counts.where(F.col(count) > max(least, total // SHARE)).select(*keys).collect()]


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard: int = SHARD, memory: int = MEMORY) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, class, n_bytes, sha256, copies) of docs (doc_id, text), and a table class, text, spans of texts without copies that have repeated strings.

    spans: first and last places of strings of `length` bytes that begin elsewhere too.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("class", F.xxhash64("text", F.octet_length("text")))
    rows = cut(docs.select("doc_id", "class", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256")), "suffix-rows")
    classes = cut(rows.groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "suffix-classes")
    table = cut(_owner_table(docs.where(F.octet_length("text") >= length), length, gram), "suffix-owners")
    ends = table.groupBy("h").agg(F.min(F.struct("class", "first")).alias("a"), F.max(F.struct("class", "first")).alias("b"), F.count("*").alias("n"))
    again = cut(ends.where("a <> b").select("h", "n"), "suffix-again")
    common = F.col("h").isin([h for (h,) in _frequent(again, "n", ["h"], hot)])
    wanted = table.where(common).unionByName(table.where(~common).join(again, "h", "left_semi")).distinct().groupBy("class").agg(F.collect_list(F.struct("h", "first", "last")).alias("wanted"))
    wanted = wanted.join(classes, "class")
    text = docs.select("doc_id", "class", "text")
    suspects = text.join(wanted, (text["class"] == wanted["class"]) & text["doc_id"].eqNullSafe(wanted["rep"])).select(text["class"], "copies", "text", "wanted")
    suspects = cut(suspects, "suffix-suspects")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()
        names = ["h", "f1", "f2", "class", "first", "starts", "stretch"]
        kinds = [pa.int64()] * 6 + [pa.large_binary()]

        def batch_of(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            out, size = [], 0
            for c, text, ws in zip(batch.column("class").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                for w in ws:
                    piece = text[w["first"] : w["last"] + length]
                    d = hashlib.blake2b(piece, digest_size=16).digest()
                    f1, f2 = (int.from_bytes(x, "little", signed=True) for x in (d[:8], d[8:]))
                    key = (w["h"], f1, f2)
                    out.append((*key, c, w["first"], w["last"] - w["first"] + 1, None if key in seen else piece))
                    size += 0 if key in seen else len(piece)
                    seen.add(key)
                    if size > 4 << 20 or len(out) >= 20_000:
                        yield batch_of(out)
                        out, size = [], 0
            if out:
                yield batch_of(out)

    pieces_ = suspects.select("class", "text", "wanted").mapInArrow(cut_out, "h long, f1 long, f2 long, class long, first long, starts long, stretch binary")
    pieces_ = cut(pieces_, "suffix-stretches")
    drop_cut(table)
    kinds = pieces_.groupBy("h", "f1", "f2").agg(F.count("*").alias("n"), F.max("starts").alias("starts"), F.max("stretch").alias("stretch"))
    kinds = cut(kinds, "suffix-kinds")
    groups = kinds.groupBy("h").agg(F.count("*").alias("kinds"))
    groups = cut(groups, "suffix-groups")
    crowded = F.col("h").isin([h for (h,) in _frequent(groups, "kinds", ["h"], hot)])
    whole = F.array(F.struct(F.lit(0).cast("long").alias("x"), (F.col("starts") - 1).alias("y")))
    alone = kinds.where("n > 1").where(~crowded).join(groups.where("kinds = 1"), "h", "left_semi").select("h", "f1", "f2", whole.alias("spans"))
    others = kinds.where(~crowded)
    mixed = others.join(groups.where(f"kinds > 1 AND kinds <= {hot}"), "h", "left_semi")
    mixed = mixed.repartition(F.col("h")).sortWithinPartitions("h", "f1", "f2")
    spans = alone.unionByName(_sorted_spans(mixed, length, shard, memory)).unionByName(_hot_spans(kinds.where(crowded).unionByName(others.join(groups.where(f"kinds > {hot}"), "h", "left_semi")), length))
    spans = cut(spans, "suffix-spans")
    key = ["h", "f1", "f2"]
    repeats = docs.sparkSession.createDataFrame(_frequent(kinds, "n", key, hot), "h long, f1 long, f2 long")
    held = pieces_.select(*key, "class", "first")
    few = F.broadcast(spans.join(F.broadcast(repeats), key, "left_semi"))  # SHARE rows at most
    found = held.join(few, key).unionByName(held.join(F.broadcast(repeats), key, "left_anti").join(spans, key))
    found = found.select("class", F.transform("spans", lambda s: F.struct((s["x"] + F.col("first")).alias("x"), (s["y"] + F.col("first")).alias("y"))).alias("s"))
    found = found.groupBy("class").agg(F.flatten(F.collect_list("s")).alias("spans"))
    found = suspects.where("copies = 1").select("class", "text").join(found, "class")
    often = F.col("class").isin([c for (c,) in _frequent(classes, "copies", ["class"], hot)])
    classes = classes.select("class", "copies")
    rows = rows.where(often).join(F.broadcast(classes.where(often)), "class").unionByName(rows.where(~often).join(classes, "class"))
    return rows, found


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, shard: int = SHARD, memory: int = MEMORY, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeated (whether anything is removed) for each row of docs (doc_id, text), and with_text
    the bytes left (column kept).

    Texts are judged as UTF-8 bytes; null counts as empty. Texts shorter than `length` lose nothing. Copies (repeated rows too) lose all if they are long
    enough, each of them. A spare cut within a character can leave bytes that are no text, so what is left is binary.
    """
    rows, found = repeated_spans(docs, length, gram, hot, shard, memory)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, text, spans in zip(batch.column("class").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                kept, end, n, gone = [], 0, 0, 0
                for x, y in sorted((s["x"], s["y"] + length) for s in spans):
                    if x > end or n == 0:
                        kept.append(text[end:x])
                        n += 1
                        end = x
                    gone += max(0, y - end)
                    end = max(end, y)
                left = b"".join([*kept, text[end:]])
                out.append((c, gone, n, hashlib.sha256(left).hexdigest(), left if with_text else None))
            c, gone, n, sha, left = zip(*out, strict=True) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(gone, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.binary())], ["class", "gone", "n", "sha", "left"])

    cleaned = cut(found.mapInArrow(remove, "class long, gone long, n long, sha string, left binary"), "suffix-cleaned")
    all_ = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    single = F.col("copies") == 1
    out = rows.where(single).join(cleaned, "class", "left").unionByName(rows.where(~single), allowMissingColumns=True)
    cols = [
        "doc_id",
        "n_bytes",
        F.when(all_, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_, F.lit(1)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "sha256")).alias("kept_sha256"),
        (all_ | (F.coalesce("gone", F.lit(0)) > 0)).alias("repeated"),
    ]
    if not with_text:
        return out.select(*cols)
    own = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("class", F.xxhash64("text", F.octet_length("text"))).dropDuplicates(["class"])
    return out.join(own, "class").select(*cols, F.when(all_, F.lit(b"")).otherwise(F.coalesce("left", F.col("text").cast("binary"))).alias("kept"))
