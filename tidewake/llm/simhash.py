"""Near duplicates by SimHash fingerprints, found by fuzzy hashing with the binary Golay code.

A fingerprint has 64 bits: of each, whether it is set in over half the hashes of the text's word shingles. Fingerprints link that differ in at
most BITS = 4 bits. They are cut into segments of 22, 21 and 21 bits. The perfect [23, 12] Golay code decodes any segment to the index of the
one codeword within three bits; a segment's keys are the indices of itself and of its neighbours at one bit, six at most, and two
segments that differ in at most two bits have one in common (that of a word between them). By the pigeonhole principle, of two fingerprints that
link either one segment is equal and another differs in two bits at most, or all three differ in one or two. So the keys of a
fingerprint are every (equal segment, index of another) and every triple of indices, of 33 to 36 bits: 180 on average, and random
fingerprints hardly ever share one.

Equal fingerprints are one row before keys are made. Rows of one key are compared with the key's hub first, whose choice depends on the key, so
that a dense group is joined by many different hubs and its pairs are never expanded. What then lies in another component than its hub
(few rows) is compared with all rows of the key, dealt by salt; the comparison is the join's own condition, and only pairs of components come out.
Each link shares a key, so components are exact.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, spread
from .graph import components
from .textnum import _LOWER, _SPACE, pieces, raw, words

SIZE = 4  # words of a shingle
SEED = 42  # of the shingles' hash, XXH64
BITS = 4  # differing bits of a link, at most; the keys below are complete for this number
WIDTHS = (22, 21, 21)  # bits of the segments, from the highest
ROWS = 8192  # fingerprints whose keys one task makes, about
SALT = 1024  # rows of one key that are compared in one group, about
CHUNK = 1 << 16  # hashes whose bits are counted at once
#: Fixed value: the generator polynomial of the binary Golay code.
GENERATOR = 0xC75


def _remainders() -> np.ndarray:
    """Of each word of 23 bits whose low 11 are zero (by its high 12), the remainder by the generator."""
    out = np.arange(1 << 12, dtype=np.int64) << 11
    for k in range(22, 10, -1):
        out = np.where(out >> k & 1, out ^ (GENERATOR << (k - 11)), out)
    return out


_REMAINDER = _remainders()


def _syndrome(words: np.ndarray) -> np.ndarray:
    return _REMAINDER[words >> 11] ^ (words & 0x7FF)


def _errors() -> np.ndarray:
    """The pattern of at most three wrong bits with each syndrome; the code is perfect, so there is exactly one."""
    patterns = np.array([sum(1 << k for k in ks) for n in range(4) for ks in itertools.combinations(range(23), n)], np.int64)
    out = np.zeros(1 << 11, np.int64)
    out[_syndrome(patterns)] = patterns
    return out


_ERROR = _errors()


def nearest(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword within three bits of each word of 23 bits."""
    return (words ^ _ERROR[_syndrome(words)]) >> 11


def indices(segment: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment, six codeword indices and which of them count (the rest repeat others)."""
    flips = np.array([0, *(1 << k for k in range(width))], np.int64)
    found = np.sort(nearest(segment[:, None] ^ flips[None]), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    at = np.argsort(~new, axis=1, kind="stable")[:, :6]
    return np.take_along_axis(found, at, 1), np.take_along_axis(new, at, 1)


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the fingerprints (uint64), one after another, and how many each has."""
    shifts = [sum(WIDTHS[k + 1 :]) for k in range(3)]
    seg = [((fingerprints >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in zip(shifts, WIDTHS, strict=True)]
    own = [indices(s, w) for s, w in zip(seg, WIDTHS, strict=True)]
    n, parts = len(fingerprints), []
    for tag, (i, j) in enumerate(itertools.permutations(range(3), 2)):
        parts.append(((tag << 40 | seg[i] << 12)[:, None] | own[j][0], own[j][1]))
    (a, ua), (b, ub), (c, uc) = own
    triples = a[:, :, None, None] << 24 | b[:, None, :, None] << 12 | c[:, None, None, :] | 6 << 40
    parts.append((triples.reshape(n, -1), (ua[:, :, None, None] & ub[:, None, :, None] & uc[:, None, None, :]).reshape(n, -1)))
    value, use = (np.concatenate(x, axis=1) for x in zip(*parts, strict=True))
    return value[use], use.sum(1)


def fingerprint_batch(batch: pa.RecordBatch, size: int = SIZE) -> np.ndarray:
    """The fingerprint (uint64) of each row's text."""
    from xxhash import xxh64_intdigest

    data, at = raw(batch.column("text"))
    starts, ends, first = words(data, at)
    # the words of each text, lower-cased, with one space after each
    keep = ~_SPACE[data]
    clean, place = _LOWER[data[keep]], np.concatenate(([0], np.cumsum(keep)))
    begin, end = place[starts], place[ends]  # without the spaces
    n = len(starts)
    spaced = np.full(len(clean) + n, 0x20, np.uint8)
    spaced[np.arange(len(clean)) + np.repeat(np.arange(n), end - begin)] = clean
    begin, end = begin + np.arange(n), end + np.arange(n)
    many = np.diff(first)
    count = np.where(many >= size, many - size + 1, np.minimum(many, 1))
    to = np.concatenate(([0], np.cumsum(count)))
    left = np.repeat(first[:-1] - to[:-1], count) + np.arange(to[-1])
    right = left + np.repeat(np.minimum(many, size), count) - 1
    joined, ones = spaced.tobytes(), np.zeros((len(many), 64), np.int64)
    for i in range(0, int(to[-1]), CHUNK):
        j = min(i + CHUNK, int(to[-1]))
        h = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begin[left[i:j]].tolist(), end[right[i:j]].tolist(), strict=True)), np.uint64, j - i)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        texts = np.arange(np.searchsorted(to, i, "right") - 1, np.searchsorted(to, j))  # those with hashes in this chunk, and empty ones among them
        texts = texts[count[texts] > 0]
        ones[texts] += np.add.reduceat(bits, np.maximum(to[texts] - i, 0), axis=0, dtype=np.int64)
    return np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, fp (the fingerprint as a long) for each row of docs (doc_id, text; other columns are not read).

    A-Z are lower-cased, words are `[^\\x20\\x09-\\x0D]+` of the whole text. Fewer words than a shingle has are one shingle; null and empty texts and
    those without words have fingerprint zero. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fingerprint_batch(b, size).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _keyed(fps: DataFrame) -> DataFrame:
    """key, fp for each key of the fingerprints (fp: long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value, many = keys(b.column("fp").to_numpy().view(np.uint64))
            at = pa.array(np.concatenate(([0], np.cumsum(many))), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("fp"), pa.ListArray.from_arrays(at, pa.array(value))], ["fp", "keys"])

    return fps.mapInArrow(run, "fp long, keys array<long>").select(F.explode("keys").alias("key"), "fp")


def linked(fps: DataFrame) -> DataFrame:
    """fp, component for each of the different fingerprints fps (fp: long) that is linked with another, directly or through others."""
    near = f"bit_count({{}} ^ {{}}) <= {BITS}"
    rows = _keyed(fps.repartition(max(1, -(-fps.count() // ROWS)), "fp"))  # a row becomes 180
    # the hub: the fingerprint that comes first after its bits were changed by the key's
    hubs = rows.groupBy("key").agg(F.min(F.col("fp").bitwiseXOR(F.col("key"))).alias("_least"), F.count("*").alias("many")).where("many > 1")
    met = cut(rows.join(spread(hubs), "key").select("key", "fp", F.col("_least").bitwiseXOR(F.col("key")).alias("hub"), "many"), "simhash-met")
    first = components(met.where("fp <> hub AND " + near.format("fp", "hub")).select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct())
    first = cut(first, "simhash-first")
    of = lambda c: first.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))
    told = met.join(spread(of("fp")), "fp", "left").join(spread(of("hub")), "hub", "left").select("key", "fp", "many", F.coalesce("fp_in", "fp").alias("own"), F.coalesce("hub_in", "hub").alias("of_hub"))
    told = cut(told, "simhash-told")
    drop_cut(met)
    salts = F.ceil(F.col("many") / SALT).cast("int")
    out = told.where("own <> of_hub").select("key", F.col("fp").alias("x"), F.col("own").alias("x_own"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    every = told.join(spread(told.where("own <> of_hub").select("key").distinct()), "key", "left_semi")
    every = every.select("key", F.col("fp").alias("y"), F.col("own").alias("y_own"), F.pmod(F.xxhash64("fp"), salts).cast("int").alias("salt"))
    more = out.join(spread(every), (out["key"] == every["key"]) & (out["salt"] == every["salt"]) & (out["x_own"] != every["y_own"]) & F.expr(near.format("x", "y")))
    joined = cut(components(more.select(F.col("x_own").alias("a"), F.col("y_own").alias("b")).distinct()), "simhash-joined")
    drop_cut(told)
    # components of the first links, and fingerprints that had none, in those of all links
    nodes = first.select(F.col("node").alias("fp"), F.col("component").alias("_one")).unionByName(joined.join(spread(first), "node", "left_anti").select(F.col("node").alias("fp"), F.col("node").alias("_one")))
    return nodes.join(spread(joined.select(F.col("node").alias("_one"), F.col("component").alias("_two"))), "_one", "left").select("fp", F.coalesce("_two", "_one").alias("component"))


def near_duplicates(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id, same (rows of that fingerprint) for each row of docs (doc_id, text).

    component_id: the smallest doc_id reachable by links. Texts without words have fingerprint zero and link like others. Repeated rows give
    repeated results; of rows without a doc_id, component_id is that of their component, null if no row there has one. An empty table gives no rows.
    """
    found = cut(fingerprints(docs, size), "simhash-fingerprints")
    each = found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("same"))
    each = cut(each, "simhash-different")
    named = cut(each.join(spread(linked(each.select("fp"))), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "simhash-named")
    top = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(spread(top), "component").select("fp", "component_id", "same")
    return found.join(spread(named), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "same")
