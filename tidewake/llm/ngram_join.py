"""N-gram Jaccard self-join: documents whose sets of word shingles have a Jaccard similarity of at least 4/5, as components.

1. Equal sets are one class from the start, so copies cost one row.
2. In how many classes a shingle occurs is counted exactly: shingles are dealt by hash to tasks of about DEAL of them, as arrays. Those of
   one class only can't be shared, and go. Shingles of very full buckets (a table of BUCKETS counts) would meet in one task; their order
   is that of the bucket's count, after all others, and they are not dealt by hash.
3. The shared shingles come back to their class, dealt by class. A class with fewer than 4/5 of its set shared is linked with nothing. The
   others order theirs rare first; two sets that are similar enough have one in common among the first d - ceil(0.8 n) + 1 of each (d shared
   shingles, n in all), so only classes with a common one among these are paired.
4. Pairs must pass the length filter, the positional filter (at their common shingle; true pairs pass it at their first one) and the suffix filter
   (what ranges of hashes can have in common), all before sets travel. What is left is compared once, set against set.
5. Rows of one shingle are first paired with their hub only, the class with the largest shared part (in a group of near copies, the text they
   were made from); then with neighbours in size. Verified links give components. At last all rows of one shingle in different components are
   paired, by bands of size, so no link that joins components is lost, while a group of near copies costs pairs in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut
from .graph import components
from .textnum import U, mix, pieces, raw, shingles, word_hashes, words

SIZE = 5  # words of a shingle
LOW, HIGH = 4, 5  # least similarity, as a fraction
BUCKETS = 1 << 16  # counts that tell very frequent shingles: a table of this many numbers
HEAVY = 4096  # a bucket is very full above this count, and above 8 times the mean
DEAL = 1 << 21  # shingles that meet in one task, about
RANGES = 16  # ranges of hashes that the suffix filter counts in
_LATE = 1 << 40  # added to the counts of very full buckets, so that they come last


def shingle_sets(batch: pa.RecordBatch, size: int = SIZE) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batch with, for each text, its set of shingles (sorted unsigned 64-bit hashes)."""
    for b in pieces(batch, "text"):
        data, at = raw(b.column("text"))
        starts, ends, first = words(data, at)
        h, begin = shingles(word_hashes(data, starts, ends), first, size)
        yield b, [np.unique(h[x:y]) for x, y in zip(begin[:-1], begin[1:], strict=True)]


def set_class(s: np.ndarray) -> int | None:
    """A 64-bit fingerprint of a set; None of the empty one."""
    if not len(s):
        return None
    with np.errstate(over="ignore"):
        x = mix(s)
        return int(mix(np.array([x.sum(dtype=U) + mix(np.array([len(s)], U))[0] + np.bitwise_xor.reduce(mix(x + U(11)))], U)).view(np.int64)[0])


def _bucket(s: np.ndarray) -> np.ndarray:
    return ((s >> U(20)) % U(BUCKETS)).astype(np.int64)


def _scan(docs: DataFrame, size: int) -> DataFrame:
    """kind 0: doc_id, n, class of each row; kind 1: a bucket (in doc_id) and how many shingles (n) one task found in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = np.zeros(BUCKETS, np.int64), set()
        names = ["kind", "doc_id", "n", "class"]
        for batch in batches:
            for b, sets in shingle_sets(batch, size):
                named = [set_class(s) for s in sets]
                fresh = []
                for c, s in zip(named, sets, strict=True):
                    if c is not None and c not in seen:
                        seen.add(c)
                        fresh.append(s)
                if fresh:
                    count += np.bincount(_bucket(np.concatenate(fresh)), minlength=BUCKETS)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(named, pa.int64())], names)
        k = np.flatnonzero(count)
        for i in range(0, len(k), 1 << 16):
            x = k[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(x), np.int32)), pa.array(x), pa.array(count[x]), pa.nulls(len(x), pa.int64())], names)

    return docs.select("doc_id", "text").mapInArrow(run, "kind int, doc_id long, n long, class long")


_DEALT = "part long, h binary, df binary, class binary, n binary, many binary"
_DEALT_ARROW = pa.schema([("part", pa.int64()), *((c, pa.large_binary()) for c in ("h", "df", "class", "n", "many"))])


def _blobs(part: np.ndarray, h: np.ndarray, df: np.ndarray, c: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row for each part: the bytes of its shingles and their counts, and runs of one class (class, n, shingles): many values travel as one row.

    Shingles of one class stand together.
    """
    order = np.argsort(part, kind="stable")
    p, c, n = part[order], c[order], n[order]
    new = np.ones(len(p), bool)
    new[1:] = p[1:] != p[:-1]
    cuts = np.append(np.flatnonzero(new), len(p))
    new[1:] |= c[1:] != c[:-1]
    run = np.append(np.flatnonzero(new), len(p))
    runs = np.searchsorted(run, cuts)

    def binary(at: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * values.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))])

    return pa.RecordBatch.from_arrays([pa.array(p[cuts[:-1]]), binary(cuts, h[order]), binary(cuts, df[order]), *(binary(runs, x) for x in (c[run[:-1]], n[run[:-1]].astype(np.int32), np.diff(run).astype(np.int32)))], schema=_DEALT_ARROW)


def _unblob(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """h, df, class and n of all shingles of the rows."""
    h, df, c, n, many = (np.frombuffer(b"".join(t.column(x).to_pylist()), k) for x, k in (("h", U), ("df", np.int64), ("class", np.int64), ("n", np.int32), ("many", np.int32)))
    return h, df, np.repeat(c, many), np.repeat(n, many)


def _dealt(docs: DataFrame, heavy: np.ndarray, parts: int, size: int) -> DataFrame:
    """The shingles of all classes, by part: of rows with an id, a class once a task. df is set where the bucket is very full."""
    shared = docs.sparkSession.sparkContext.broadcast(heavy)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = shared.value, set()
        for batch in batches:
            hs, cs = [], []
            for b, sets in shingle_sets(batch, size):
                for i, s in zip(b.column("doc_id").is_valid().to_pylist(), sets, strict=True):
                    c = set_class(s) if i else None
                    if c is not None and c not in seen:
                        seen.add(c)
                        hs.append(s)
                        cs.append(c)
            if hs:
                lens = np.array([len(s) for s in hs], np.int64)
                h, c, n = np.concatenate(hs), np.repeat(np.array(cs, np.int64), lens), np.repeat(lens, lens)
                df = often[_bucket(h)]
                part = (np.where(df > 0, mix(c.view(U)), h) >> U(11)) % U(parts)  # very frequent ones are dealt by class
                yield _blobs(part.astype(np.int64), h, df, c, n)

    return docs.select("doc_id", "text").mapInArrow(run, _DEALT)


def _shared(parts: int):
    """Of the shingles of one part, those of two classes or more with the number of classes, dealt by class."""

    def run(t: pa.Table) -> pa.Table:
        h, df, c, n = _unblob(t)
        late, light = np.flatnonzero(df > 0), np.flatnonzero(df == 0)
        order = light[np.argsort(h[light])]
        x = h[order]
        twice = np.zeros(len(x), bool)
        twice[1:] = x[1:] == x[:-1]
        twice[:-1] |= twice[1:].copy()
        order = order[twice]  # a few; now copies of a class from other tasks go
        order = order[np.lexsort((c[order], h[order]))]
        x, y = h[order], c[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        order = order[new]
        _, at, many = np.unique(h[order], return_inverse=True, return_counts=True)
        many = many[at]
        keep, many = order[many > 1], many[many > 1]
        use, counts = np.concatenate((keep, late)), np.concatenate((many, df[late]))
        by = np.argsort(c[use], kind="stable")
        use, counts = use[by], counts[by]
        out = pa.Table.from_batches([_blobs(((mix(c[use].view(U)) >> U(11)) % U(parts)).astype(np.int64), h[use], counts, c[use], n[use])])
        return out.cast(pa.schema([("part", pa.int64()), *((x.name, pa.binary()) for x in list(_DEALT_ARROW)[1:])]))

    return run


_CANDIDATES = pa.schema([("class", pa.int64()), ("n", pa.int32()), ("d", pa.int32()), ("often", pa.float64()), ("marks", pa.list_(pa.int32())), ("prefix", pa.list_(pa.int64())), ("set", pa.list_(pa.int64()))])


def _candidates(t: pa.Table) -> pa.Table:
    """Of each class with enough shared shingles: their number d, the mean logarithm of their counts, counts by ranges of hashes, the prefix
    (rare first) and the set (sorted unsigned hashes)."""
    h, df, c, n = _unblob(t)
    order = np.argsort(c, kind="stable")
    many = np.diff(np.concatenate(([0], np.flatnonzero(np.diff(c[order])) + 1, [len(c)]))) if len(c) else np.zeros(0, np.int64)
    order = order[np.repeat(many, many) * HIGH >= n[order] * LOW]
    order = order[np.lexsort((h[order], df[order], c[order]))]
    x, y = h[order], c[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    order = order[new]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(c[order])) + 1, [len(order)])) if len(order) else np.zeros(1, np.int64)
    rows = []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        own, d, size = h[order[i:j]], int(j - i), int(n[order[i]])
        k = d - -(-LOW * size // HIGH) + 1
        if k > 0:
            marks = np.bincount((own >> U(60)).astype(np.int64), minlength=RANGES)
            rows.append((int(c[order[i]]), size, d, float(np.log(df[order[i:j]] % _LATE + 1).mean()), marks, own[:k].view(np.int64), np.sort(own).view(np.int64)))
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_CANDIDATES), _CANDIDATES, strict=True)], schema=_CANDIDATES)


def similar(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> bool:
    """Whether sets of na and nb shingles, whose parts a and b (sorted unsigned hashes) hold all that they can share, have a similarity of LOW / HIGH."""
    a, b = a.view(U), b.view(U)
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return (LOW + HIGH) * int((b[at] == a).sum()) >= LOW * (na + nb)  # HIGH * o >= LOW * (na + nb - o)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b: classes) that are similar enough. Each pair is compared once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (xv, xo), (yv, yo) = ((c.flatten().to_numpy(), np.concatenate(([0], np.cumsum(c.value_lengths().to_numpy())))) for c in (b.column("sa"), b.column("sb")))
            na, nb = b.column("na").to_pylist(), b.column("nb").to_pylist()
            keep = [similar(xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]], na[i], nb[i]) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("class").alias(c), F.col("set").alias("s" + c), F.col("n").alias("n" + c)) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long")


def _passes(a: str, b: str) -> str:
    """Length, positional and suffix filter of two rows of one shingle (structs of class, n, d, pos, marks)."""
    length = f"{HIGH} * least({a}.n, {b}.n) >= {LOW} * greatest({a}.n, {b}.n)"
    need = f"{LOW} * ({a}.n + {b}.n)"
    place = f"{LOW + HIGH} * least({a}.d - {a}.pos, {b}.d - {b}.pos) >= {need}"
    suffix = f"{LOW + HIGH} * aggregate(zip_with({a}.marks, {b}.marks, (x, y) -> least(x, y)), 0, (s, x) -> s + x) >= {need}"
    return f"{a}.class <> {b}.class AND {length} AND {place} AND {suffix}"


def links_of(docs: DataFrame, heavy: np.ndarray, total: int, size: int) -> DataFrame:
    """a, b: verified links between classes, enough for every component."""
    parts = max(1, -(-total // DEAL))
    dealt = _dealt(docs, heavy, parts, size).groupBy("part").applyInArrow(_shared(parts), _DEALT)
    found = cut(dealt.groupBy("part").applyInArrow(_candidates, "class long, n int, d int, often double, marks array<int>, prefix array<long>, set array<long>"), "jaccard-candidates")
    sets = found.select("class", "n", "set")
    rows = found.select(F.posexplode("prefix").alias("pos", "h"), "class", "n", "d", "marks", "often").select("h", F.struct("class", "n", "d", "pos", "marks").alias("x"), F.struct(F.expr("d / n").alias("part"), "often", "class").alias("rank"))
    # hubs: aggregated before they are joined, so a shingle of very many rows is split by the join
    hubs = rows.groupBy("h").agg(F.max_by("x", "rank").alias("y"), F.count("*").alias("many")).where("many > 1").drop("many")
    met = cut(rows.join(hubs, "h"), "jaccard-met")
    done = links = None

    def verify(pairs: DataFrame) -> None:
        """Add the links among pairs x, y that were not compared before."""
        nonlocal done, links
        new = pairs.where(_passes("x", "y")).select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()
        new = cut(new if done is None else new.join(done, ["a", "b"], "left_anti"), "jaccard-pairs")
        good = cut(_verified(new, sets), "jaccard-links")
        done, links = (new, good) if done is None else (done.unionByName(new), links.unionByName(good))

    def apart() -> DataFrame:
        """h, x, component of the rows of shingles whose rows are in different components."""
        groups = components(links).withColumnRenamed("node", "_class")
        told = met.select("h", "x").join(groups, F.col("x.class") == F.col("_class"), "left").select("h", "x", F.coalesce("component", "x.class").alias("component"))
        told = cut(told, "jaccard-told")
        mixed = told.groupBy("h").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("h")
        out = cut(told.join(mixed, "h", "left_semi"), "jaccard-apart")
        drop_cut(told)
        return out

    verify(met.select("x", "y"))
    left = apart()
    # neighbours in size: within a salt, so that no shingle's rows are sorted in one task
    by = Window.partitionBy("h", F.pmod(F.xxhash64("component"), F.lit(16))).orderBy("x.n", "x.class")
    near = left.select("x", "component", F.lag("x").over(by).alias("y"), F.lag("component").over(by).alias("other"))
    verify(near.where("component <> other").select("x", "y"))
    drop_cut(left)
    left = apart().withColumn("band", F.floor(F.log("x.n") / F.log(F.lit(HIGH / LOW))).cast("int"))
    other = left.select("h", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), F.col("x").alias("y"), F.col("component").alias("other"))
    verify(left.join(other, ["h", "band"]).where("component < other").select("x", "y"))
    drop_cut(left)
    drop_cut(met)
    drop_cut(found)
    return links


def jaccard_components(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles, component_id, set_class, class_size, class_links for each row of docs (doc_id, text).

    A-Z are lower-cased, words are `[^\\x20\\x09-\\x0D]+` of the whole text. Fewer words than a shingle has are one shingle; texts without
    words (null, empty) have none and are alone. class_links: verified links of the row's class with other classes (a spanning part of them
    where a group of near copies was joined by its hub). Ties and repeated rows: equal sets are one class, with the smallest doc_id as its
    first. Rows whose whole class has no doc_id link with nothing else, and their component_id is null.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scan = cut(_scan(docs, size), "jaccard-scan")
    count = np.zeros(BUCKETS, np.int64)
    sums = scan.where("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    count[sums.column("doc_id").to_numpy()] = sums.column("n").to_numpy()
    heavy = np.where(count > max(HEAVY, 8 * count.mean()), count + _LATE, 0)
    every = scan.where("kind = 0").select("doc_id", "n", "class")
    links = cut(links_of(docs, heavy, int(count.sum()), size), "jaccard-links")
    groups = components(links).withColumnRenamed("node", "class")
    ends = links.select(F.col("a").alias("class")).unionByName(links.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("class_links"))
    reps = every.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("rep"), F.count("*").alias("class_size"))
    named = cut(reps.join(groups, "class", "left").withColumn("component", F.coalesce("component", "class")), "jaccard-named")
    top = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = cut(named.join(top, "component").join(ends, "class", "left").drop("component", "rep"), "jaccard-classes")
    out = every.join(named, "class", "left")
    alone = F.col("class").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("class").alias("set_class"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("class_links", F.lit(0)).alias("class_links"))
