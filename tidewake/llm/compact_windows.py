"""Near-duplicate passages by compact windows.

A text is the sequence of its word shingles. Under a hash function, all runs of RUN shingles or more whose smallest hash stands at place c are
one compact window (l, c, r): they begin in l..c and end in c..r. A text of n shingles has about 2n / RUN windows. They are the nodes of the
Cartesian tree over the hashes whose ranges are long enough; a sliding minimum finds these nodes, and only over them the tree is built.

One function is enough, as nothing is left to chance: two texts with a common run of RUN shingles have a window with the same centre there. And
passages of `least` (50) words with Jaccard similarity SIMILAR have such a run. Let o shingles be common, M in one passage alone, so M <= o / 4
and o >= 41; let the common ones lie in s runs. Between two runs each passage has 4 shingles at least that the other has not, fewer by as many as
words happen to be repeated at the edges; at 6 for both passages together, o >= 24 (s - 1), and one run has 16 shingles or more.

Texts with a window of the same smallest hash are paired with the first such text, their head; where a key has more than two texts (it may stand
in a line that many texts hold in different surroundings), also with the head of those that have the same words before the centre, and of those
with the same after it: a common run reaches NEAR shingles to one side of its centre. Pairs with heads join all texts of a passage; cluster_id says
which rows are reachable from each other. Texts of a key that verification leaves in different clusters are then paired with each other (rest()).

The windows of a pair are joined as intervals, those on nearly one diagonal as a candidate region. Only the candidates' segments are fetched, and
compared shingle by shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, spread
from .graph import components
from .textnum import U, mix, pieces, raw, shingles, word_hashes, words

SIZE = 5  # words of a shingle
LEAST = 50  # words of a passage
SIMILAR = 0.8  # least Jaccard similarity of passages
RUN = 16  # shingles of a run that has a window
NEAR = RUN // 2  # shingles that a run reaches to one side of its centre, at least
ENOUGH = 41  # shingles of a run that is a passage of `least` words with any others beside it: 41 of 51
FEW = 8  # texts of a key that are all paired where it has two clusters or more
SLACK = 8  # words by which diagonals of one region may differ
GAP = 64  # shingles between windows of one region, at most
PAD = 168  # shingles around a region: a passage that holds no shorter one has 182 at most (runs of 45, gaps of 22)
AROUND = PAD + RUN  # shingles from a centre to either end of such a passage, at most
PORTIONS = 8  # of centres whose surroundings are counted one after another
GRID = 64  # segments begin and end at multiples of it, so that those of one passage are the same
FAR = (1 << 18) - 1  # shingles from its centre that a window is stored with; what lies beyond has windows of its own, nested in it
_SEEDS = [U(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1)) for k in range(4)]


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each run of n values, by doubling."""
    k, out = 1, x
    while 2 * k <= n:
        out = np.minimum(out[:-k], out[k:])
        k *= 2
    return np.minimum(out[: len(x) - n + 1], out[n - k : len(x) - k + 1]) if n > k else out


def windows(h: np.ndarray, begin: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Compact windows of runs of n values or more: text, l, c, r (places in the text) and the value at c.

    h: hashes (unsigned) of all texts' places; begin: where each text begins in it. Equal values count as ordered by place.
    """
    none = np.zeros(0, np.int64)
    if len(h) < n:
        return none, none, none, none, none.view(U)
    bits = max(21, len(h).bit_length())  # a slice has fewer than 2**21 places but where one text has more
    packed = (h >> U(bits) << U(bits)) | np.arange(len(h), dtype=U)
    low = sliding_least(packed, n)
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    own = text[: len(low)] == text[n - 1 :]
    new = own.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~own[:-1]
    centre = (low[new] & U((1 << bits) - 1)).astype(np.int64)
    value, doc = packed[centre], text[centre]
    left, right = begin[doc].copy(), begin[doc + 1] - 1
    stack: list[int] = []  # the tree's right spine
    vs, ds = value.tolist(), doc.tolist()
    last = -1
    for k, (v, d) in enumerate(zip(vs, ds, strict=True)):
        if d != last:
            stack, last = [], d
        while stack and vs[stack[-1]] > v:
            right[stack.pop()] = centre[k] - 1
        if stack:
            left[k] = centre[stack[-1]] + 1
        stack.append(k)
    # a smaller value that is no node may stand nearer; then the runs that the node is least of show where
    first = np.flatnonzero(new)
    after = np.concatenate((np.flatnonzero(~own[1:] | (low[1:] != low[:-1])), [len(low) - 1])) if len(low) else none
    end = after[np.searchsorted(after, first)]
    left = np.where(first > np.maximum(centre - n + 1, begin[doc]), np.maximum(left, first), left)
    right = np.where(end < np.minimum(centre, begin[doc + 1] - n), np.minimum(right, end + n - 1), right)
    base = begin[doc]
    return doc, left - base, centre - base, right - base, h[centre]


def _pack(left: np.ndarray, centre: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (centre << 36) | (np.minimum(centre - left, FAR) << 18) | np.minimum(right - centre, FAR)


def _unpack(w: int) -> tuple[int, int, int]:
    c = w >> 36
    return c - (w >> 18 & FAR), c, c + (w & FAR)


def _sequence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = raw(column)
    starts, ends, first = words(data, at)
    return shingles(word_hashes(data, starts, ends), first, SIZE)


def contexts(h: np.ndarray, begin: np.ndarray, doc: np.ndarray, centre: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Hashes, of 32 bits each, of the NEAR words before the centres and of those after their shingles; of `alone` of the text where it has fewer."""
    at = begin[doc] + centre
    out = []
    for x, y, ok in ((at - NEAR, at - SIZE, centre >= NEAR), (at + SIZE, at + NEAR, at + NEAR < begin[doc + 1])):
        z = alone[doc] ^ _SEEDS[1]
        z[ok] = h[x[ok]] ^ mix(h[y[ok]] ^ _SEEDS[2])
        out.append(mix(z) >> U(32))
    return ((out[0] << U(32)) | out[1]).view(np.int64)


def _counted(docs: DataFrame) -> DataFrame:
    """doc_id, class, n (words) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text", 1 << 21):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("class"), pa.array(np.diff(words(*raw(b.column("text")))[2]).astype(np.int64))], ["doc_id", "class", "n"])

    return docs.select("doc_id", "class", "text").mapInArrow(run, "doc_id long, class long, n long")


def window_table(docs: DataFrame) -> DataFrame:
    """key (a centre's hash), class, window, context, for each text class. A task emits a class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for b in pieces(batch, "text"):
                named = b.column("class").to_numpy()
                h, begin = _sequence(b.column("text"))
                fresh = np.zeros(len(named), bool)
                for k, c in enumerate(named.tolist()):
                    if c not in seen:
                        seen.add(c)
                        fresh[k] = True
                d, left, c, r, v = windows(mix(h ^ _SEEDS[0]), begin, RUN)
                use = fresh[d]
                d, left, c, r = d[use], left[use], c[use], r[use]
                near = contexts(h, begin, d, c, named.view(U))
                yield pa.RecordBatch.from_arrays([pa.array(v[use].view(np.int64)), pa.array(named[d]), pa.array(_pack(left, c, r)), pa.array(near)], ["key", "class", "window", "context"])

    return docs.select("class", "text").mapInArrow(run, "key long, class long, window long, context long")


def regions(pairs: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Candidate regions (start a, end a, start b, end b; in shingles, ends exclusive; first diagonal) of one pair of texts.

    pairs: (window in a, window in b). A region of one window pair reaches as far from the centres as both windows do; those on diagonals at
    most SLACK apart and at most GAP from each other are one.
    """
    spans = []
    for x, y in pairs:
        (la, ca, ra), (lb, cb, rb) = _unpack(x), _unpack(y)
        left, right = min(ca - la, cb - lb), min(ra - ca, rb - cb)
        if left + right + 1 >= RUN:
            spans.append((cb - ca, ca - left, ca + right + 1))
    spans.sort()
    out, k = [], 0
    while k < len(spans):
        j = k
        while j < len(spans) and spans[j][0] - spans[k][0] <= SLACK:
            j += 1
        first, last = spans[k][0], spans[j - 1][0]
        begin, end = -1, -1
        for s, e in sorted(x[1:] for x in spans[k:j]):
            if begin >= 0 and s > end + GAP:
                out.append((begin, end, max(0, begin + first), end + last, first))
                begin = -1
            begin, end = (s, e) if begin < 0 else (begin, max(end, e))
        out.append((begin, end, max(0, begin + first), end + last, first))
        k = j
    return out


def _matches(a: np.ndarray, b: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal values in a and b: all pairs of them but of values with over 64, which are taken on the diagonals low..low + SLACK only."""
    order = np.argsort(b, kind="stable")
    x, y = np.searchsorted(b, a, "left", order), np.searchsorted(b, a, "right", order)
    n = y - x
    _, which, times = np.unique(a, return_inverse=True, return_counts=True)
    n = np.where(n * times[which] <= 64, n, 0)
    i = np.repeat(np.arange(len(a)), n)
    j = order[np.repeat(x - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(i))]
    many = np.flatnonzero((n == 0) & (y > x))
    at = many + np.arange(low, low + SLACK + 1)[:, None]
    d, k = np.nonzero((at >= 0) & (at < len(b)) & (a[many] == b[np.clip(at, 0, len(b) - 1)]))
    return np.concatenate((i, many[k])), np.concatenate((j, many[k] + low + d))


def chained(a: np.ndarray, b: np.ndarray, low: int, least: int) -> tuple[int, int, int, float] | None:
    """Start and end in a, start in b and similarity of the best passage over all diagonals of two segments together, in any order of its parts.

    Each shingle is matched with one of the other segment at most, longer diagonals first. With S matches, passages of lengths x and y are
    similar where (1 + SIMILAR) * S >= SIMILAR * (x + y); a passage that is best by this excess begins and ends with whole runs of matches, in
    either text, so only these are tried: all pairs of runs that may begin and end it in a, and for each the best range in b.
    """
    n = least - SIZE + 1
    i, j = _matches(a, b, low)
    d, which, times = np.unique(j - i, return_inverse=True, return_counts=True)
    order = np.lexsort((i, which, -times[which]))
    i, j, which = i[order], j[order], which[order]
    free_a, free_b, runs = np.ones(len(a), bool), np.ones(len(b), bool), []
    edges = np.flatnonzero(np.diff(which)) + 1
    for x, y in zip(np.split(i, edges), np.split(j, edges), strict=True):
        ok = free_a[x] & free_b[y]
        x, y = x[ok], y[ok]
        free_a[x] = free_b[y] = False
        if len(x):
            runs += [(int(r[0]), int(r[-1]) + 1, int(r[0] + y[0] - x[0])) for r in np.split(x, np.flatnonzero(np.diff(x) > 1) + 1)]
    runs.sort()
    best = None
    for p, (begin, _, _) in enumerate(runs):
        total = end = 0
        for q in range(p, len(runs)):
            x, y, _ = runs[q]
            if y - begin > 2 * (PAD + n):  # it would hold a shorter passage
                break
            total, end = total + y - x, max(end, y)
            wide = max(n, end - begin)
            if (1 + SIMILAR) * total < SIMILAR * (wide + n):
                continue
            held = np.array(sorted((z, y - x) for x, y, z in runs[p : q + 1]))
            z, ends, sums = held[:, 0], held.sum(1), np.cumsum(held[:, 1])
            matched = sums - (sums - held[:, 1])[:, None]  # from the row's run to the column's
            size = wide + np.maximum(n, ends - z[:, None])
            excess = np.triu((1 + SIMILAR) * matched - SIMILAR * size + 1e6) - 1e6
            k, t = divmod(int(excess.argmax()), len(z))
            if excess[k, t] >= -1e-9 and (best is None or excess[k, t] > best[0]):
                best = (excess[k, t], begin, wide, int(z[k]), float(matched[k, t] / (size[k, t] - matched[k, t])))
    if best is None or len(a) < best[2] or len(b) < n:
        return None
    begin = min(best[1], len(a) - best[2])
    return begin, begin + best[2], min(best[3], len(b) - n), best[4]


def compare(a: np.ndarray, b: np.ndarray, low: int, least: int) -> list[tuple[int, int, int, float]]:
    """Of two segments of shingles, compared on the diagonals low..low + SLACK: start and end in a, start in b and best similarity of each
    run of similar passages of `least` words, on the first diagonal, or else on that of the others that has the best one. Without any, the best passage over all diagonals together;
    then the parts of the segments from the first to the last common shingle as sets."""
    n = least - SIZE + 1
    need = int(np.ceil(2 * n * SIMILAR / (1 + SIMILAR)))
    if len(a) < n or len(b) < n:
        return []

    def on(d: int) -> np.ndarray:
        """How many shingles are equal on diagonal d in the runs of n, from the first that both segments have."""
        x, y = max(0, -d), min(len(a), len(b) - d)
        if y - x < n:
            return np.zeros(1, np.int64)
        same = np.concatenate(([0], np.cumsum(a[x:y] == b[x + d : y + d])))
        return same[n:] - same[:-n]

    def runs(m: np.ndarray, d: int) -> list[tuple[int, int, int, float]]:
        good = np.flatnonzero(m >= need)
        parts = np.split(good, np.flatnonzero(np.diff(good) > n) + 1)
        begin = max(0, -d)
        return [(int(r[0]) + begin, int(r[-1] + n) + begin, int(r[0]) + begin + d, float(m[r].max() / (2 * n - m[r].max()))) for r in parts]

    def dense(x: np.ndarray) -> bool:
        """Whether n places or more in a row are common to the share SIMILAR, as those of a passage are."""
        total = np.concatenate(([0], np.cumsum(x * 1000 - int(1000 * SIMILAR))))
        return bool((np.maximum.accumulate(total[::-1])[::-1][n:] >= total[:-n]).any())

    if (m := on(low)).max() >= need:
        return runs(m, low)
    u, v = np.sort(a), np.sort(b)  # several times as fast as isin() on segments
    x = v[np.minimum(np.searchsorted(v, a), len(v) - 1)] == a
    if x.sum() < need:
        return []
    y = u[np.minimum(np.searchsorted(u, b), len(u) - 1)] == b
    if dense(x) and dense(y):
        all_ = [on(d) for d in range(low + 1, low + SLACK + 1)]
        k = int(np.argmax([m.max() for m in all_]))
        if all_[k].max() >= need:
            return runs(all_[k], low + 1 + k)
        if found := chained(a, b, low, least):
            return [found]
    i, j = np.flatnonzero(x), np.flatnonzero(y)
    u, v = np.unique(a[i[0] : i[-1] + 1]), np.unique(b[j[0] : j[-1] + 1])
    o = len(np.intersect1d(u, v, assume_unique=True))
    if min(i[-1] - i[0], j[-1] - j[0]) + 1 >= n and o >= SIMILAR * (len(u) + len(v) - o):
        return [(int(i[0]), int(i[-1]) + 1, int(j[0]), o / (len(u) + len(v) - o))]
    return []


def level(x: np.ndarray, x_at: np.ndarray, y: np.ndarray, y_at: np.ndarray, low: np.ndarray, least: int) -> tuple[list[np.ndarray], np.ndarray]:
    """What compare() finds on the diagonals `low` of many pairs of segments (one after another in x and y): pair, start, end, partner's start and
    similarity; and of the pairs without such passages those that have enough common shingles for compare() to find one."""
    n = least - SIZE + 1
    need = int(np.ceil(2 * n * SIMILAR / (1 + SIMILAR)))
    la, lb = np.diff(x_at), np.diff(y_at)
    begin = np.maximum(0, -low)
    size = np.maximum(0, np.minimum(la, lb - low) - begin)
    at = np.concatenate(([0], np.cumsum(size)))
    pair = np.repeat(np.arange(len(low)), size)
    place = np.arange(at[-1]) - at[:-1][pair] + begin[pair]
    total = np.concatenate(([0], np.cumsum(x[x_at[:-1][pair] + place] == y[y_at[:-1][pair] + place + low[pair]])))
    m = total[n:] - total[:-n]  # equal ones of the n from each place
    good = np.flatnonzero((m >= need) & (pair[: len(m)] == pair[n - 1 :])) if len(m) else np.zeros(0, np.int64)
    first = np.flatnonzero((np.diff(good, prepend=-n - 1) > n) | (np.diff(pair[good], prepend=-1) > 0))
    last = np.append(first[1:], len(good))[: len(first)] - 1
    k, start, end = pair[good[first]], place[good[first]], place[good[last]] + n
    best = np.maximum.reduceat(m[good], first) if len(good) else np.zeros(0, np.int64)
    left = np.ones(len(low), bool)
    left[k] = False
    left &= (la >= n) & (lb >= n)
    own, other = np.repeat(np.arange(len(low)), la), np.repeat(np.arange(len(low)), lb)
    u, v = ((o[left[o]] << 32) | (z[left[o]].astype(np.int64) & 0xFFFFFFFF) for o, z in ((own, x), (other, y)))
    v.sort()
    common = np.bincount(own[left[own]][v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u], minlength=len(low)) if len(v) else np.zeros(len(low), np.int64)
    return [k, start, end, start + low[k], best / (2 * n - best)], np.flatnonzero(left & (common >= need))


def _verified(docs: DataFrame, reps: DataFrame, met: DataFrame, least: int, name: str) -> DataFrame:
    """a, b, start_word, end_word, partner_start_word, similarity: passages of pairs of classes that have windows of one key (class, window and
    p, the other's class and window)."""
    met = met.select(F.least("class", "p.class").alias("a"), F.greatest("class", "p.class").alias("b"), F.when(F.expr("class < p.class"), F.col("window")).otherwise(F.col("p.window")).alias("wa"), F.when(F.expr("class < p.class"), F.col("p.window")).otherwise(F.col("window")).alias("wb"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, w, out = batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("w"), []
            at = np.concatenate(([0], np.cumsum(w.value_lengths().to_numpy()))).tolist()
            flat = list(zip(*(c.to_numpy().tolist() for c in w.flatten().flatten()), strict=True))
            for k in range(batch.num_rows):
                for sa, ea, sb, eb, d in regions(flat[at[k] : at[k + 1]]):
                    grid = [max(0, sa - PAD) // GRID * GRID, -(-(ea + PAD) // GRID) * GRID, max(0, sb - PAD) // GRID * GRID, -(-(eb + PAD) // GRID) * GRID]
                    out.append((a[k], b[k], *grid, d + grid[0] - grid[2]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "sa", "ea", "sb", "eb", "low"])

    # windows of one pair of texts, as many as these texts have
    found = met.groupBy("a", "b").agg(F.collect_set(F.struct("wa", "wb")).alias("w")).mapInArrow(sweep, "a long, b long, sa long, ea long, sb long, eb long, low long")
    found = cut(found.distinct(), "passage-candidates")
    wanted = found.select(F.col("a").alias("class"), F.col("sa").alias("s"), F.col("ea").alias("e")).unionByName(found.select(F.col("b").alias("class"), F.col("sb").alias("s"), F.col("eb").alias("e"))).distinct()
    wanted = wanted.groupBy("class").agg(F.collect_list(F.struct("s", "e")).alias("wanted")).join(reps.where("doc_id IS NOT NULL"), "class").select("doc_id", "wanted")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                h, begin = _sequence(b.column("text"))
                h = (h >> U(32)).astype(np.uint32).view(np.int32)  # enough for a segment's comparison
                named, out = b.column("class").to_pylist(), []
                for k, ws in enumerate(b.column("wanted").to_pylist()):
                    for w in ws:
                        out.append((named[k], w["s"], w["e"], h[begin[k] + w["s"] : min(begin[k] + w["e"], begin[k + 1])]))
                if out:
                    c, s, e, x = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(x, pa.list_(pa.int32()))], ["class", "s", "e", "x"])

    parts = docs.join(wanted, "doc_id").select("class", "text", "wanted").mapInArrow(fetch, "class long, s long, e long, x array<int>")
    stored = cut(parts, "passage-segments")
    parts = stored.dropDuplicates(["class", "s", "e"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, p, sa, sb, low = (b.column(c).to_numpy() for c in ("a", "b", "sa", "sb", "low"))
            (xv, xo), (yv, yo) = ((c.flatten().to_numpy(), np.concatenate(([0], np.cumsum(c.value_lengths().to_numpy())))) for c in (b.column("xa"), b.column("xb")))
            (k, start, end, other, alike), left = level(xv, xo, yv, yo, low, least)
            more = [(j, *r) for j in left.tolist() for r in compare(xv[xo[j] : xo[j + 1]], yv[yo[j] : yo[j + 1]], int(low[j]), least)]
            if more:
                k, start, end, other, alike = (np.concatenate(z) for z in zip((k, start, end, other, alike), map(np.array, zip(*more, strict=True)), strict=True))
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(z) for z in (a[k], p[k], sa[k] + start, sa[k] + end + SIZE - 1, sb[k] + other, alike)], schema=_JUDGED)

    full = found
    for side in "ab":
        own = parts.select(F.col("class").alias(side), F.col("s").alias(f"s{side}"), F.col("e").alias(f"e{side}"), F.col("x").alias(f"x{side}"))
        full = full.join(own, [side, f"s{side}", f"e{side}"])
    judged = cut(full.mapInArrow(judge, "a long, b long, start_word long, end_word long, partner_start_word long, similarity double"), name)
    drop_cut(found)
    drop_cut(stored)
    return judged


def _surroundings(docs: DataFrame, reps: DataFrame, rows: DataFrame) -> DataFrame:
    """What stands around the centres of rows (class, window, component), a row for each: the centre (key), the window's runs of RUN shingles that hold
    it and those of ENOUGH (hashes), and near: the shingles from AROUND before to AROUND after it, as far as the text goes, 32 bits of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, "text"):
                h, begin = _sequence(b.column("text"))
                ws = b.column("wanted")
                w = ws.flatten().to_numpy()
                k = np.repeat(np.arange(b.num_rows), ws.value_lengths().to_numpy())
                for x in range(0, len(k), 1 << 12):
                    kx, wx = k[x : x + (1 << 12)], w[x : x + (1 << 12)]
                    c, base, size = wx >> 36, begin[kx][:, None], np.diff(begin)[kx]
                    lists = []
                    for long in (RUN, ENOUGH):
                        at = c[:, None] - np.arange(long)
                        ok = (at >= (c - (wx >> 18 & FAR))[:, None]) & (at + long - 1 <= (c + (wx & FAR))[:, None])
                        place = (base + at)[ok]
                        g = np.zeros(len(place), U)
                        for step in range(0, long, SIZE):
                            g = mix(g ^ h[place + step])
                        lists.append((ok, pa.array(g.view(np.int64))))
                    at = c[:, None] + np.arange(-AROUND, AROUND + 1)
                    ok = (at >= 0) & (at < size[:, None])
                    lists.append((ok, pa.array((h[(base + at)[ok]] >> U(32)).astype(np.uint32).view(np.int32))))
                    named = [b.column(n).take(pa.array(kx)) for n in ("class", "component")]
                    lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(o.sum(1)))), pa.int32()), v) for o, v in lists]
                    yield pa.RecordBatch.from_arrays([pa.array(h[base[:, 0] + c].view(np.int64)), named[0], pa.array(wx), named[1], *lists], ["key", "class", "window", "component", "runs", "enough", "near"])

    wanted = rows.groupBy("class", "component").agg(F.collect_set("window").alias("wanted")).join(spread(reps.where("doc_id IS NOT NULL").select("class", "doc_id")), "class")
    own = docs.join(spread(wanted), ["doc_id", "class"]).dropDuplicates(["class"]).select("class", "text", "component", "wanted")
    return own.mapInArrow(run, "key long, class long, window long, component long, runs array<long>, enough array<long>, near array<int>")


def _dense(offsets: np.ndarray, least: int) -> tuple[int, int] | None:
    """From where to where the intervals reach that hold 0 and `least` of the offsets (ascending; 0 is one of them) or more, and nothing else at more than 1 - SIMILAR of their places."""
    k = int(np.searchsorted(offsets, 0))
    number = np.arange(k, len(offsets)) - np.arange(k + 1)[:, None] + 1
    size = offsets[k:] - offsets[: k + 1, None] + 1
    i, j = np.nonzero((number >= least) & (number >= SIMILAR * size - 1e-9) & (size <= 2 * AROUND))
    return (int(offsets[i.min()]), int(offsets[k + j.max()])) if len(i) else None


def _overlapping(rows: DataFrame, least: int) -> DataFrame:
    """class, window, p: all pairs of rows (key, component, class, window, near) of one key and different components that may have a passage around their centres, with `least`
    shingles or more in common.

    Such a passage in either text is an interval that holds the centre, and SIMILAR of its shingles at least stand near the key's centre in a text of another component. Rows without such an interval
    go. Where these intervals have m places of such shingles, two texts with a passage have one of the first m - least + 1 different ones in common, in any order that is the same for
    both (of equal shingles all places but one may be lost); the rarest come first.
    Of a group's rows those of its largest component are not paired with each other.
    """
    own, mid = ["key", "component", "class", "window"], F.least(F.lit(AROUND), F.shiftright("window", 36)).cast("int")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.column("m")
            at, (o, n, e), keep, out = np.concatenate(([0], np.cumsum(m.value_lengths().to_numpy()))), (c.to_numpy() for c in m.flatten().flatten()), [], []
            for k, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)):
                order = np.argsort(o[x:y])
                if reach := _dense(o[x:y][order], least):
                    use = (o[x:y] >= reach[0]) & (o[x:y] <= reach[1])
                    v, first = np.unique(e[x:y][use], return_index=True)
                    v = v[np.lexsort((v, n[x:y][use][first]))]
                    keep.append(k)
                    out.append(v[: use.sum() - least + 1])
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(keep, pa.int64())) for c in own), pa.array(out, pa.list_(pa.int32()))], [*own, "near"])

    def prefixes(rows: DataFrame) -> DataFrame:
        each = rows.select(*own, mid.alias("mid"), F.posexplode("near").alias("o", "e")).withColumn("o", F.col("o") - F.col("mid")).drop("mid")
        many = each.groupBy("key", "e").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x <> y").select("key", "e", "n")
        lists = each.join(spread(many), ["key", "e"]).groupBy(*own).agg(F.collect_list(F.struct("o", "n", "e")).alias("m"))  # 2 x AROUND + 1 a row at most
        some = lists.where(F.size("m") >= least).mapInArrow(held, "key long, component long, class long, window long, near array<int>").select(*own, F.explode("near").alias("e"))
        return cut(some, "passage-prefixes")

    some = reduce(DataFrame.unionByName, [prefixes(rows.where(F.pmod(F.xxhash64("key"), F.lit(PORTIONS)) == k)) for k in range(PORTIONS)])  # so that one portion's shuffle files are there at a time
    counts = some.groupBy("key", "e", "component").agg(F.count("*").alias("n")).groupBy("key", "e").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.count("*").alias("parts"))
    some = some.join(spread(counts.where("parts > 1").drop("parts")), ["key", "e"])
    other = some.select("key", "e", F.struct("class", "window").alias("p"), F.col("component").alias("c"))
    return some.where("component <> most").join(spread(other), ["key", "e"]).where("component <> c AND class <> p.class AND (c = most OR class < p.class)").select("class", "window", "p").distinct()


def rest(docs: DataFrame, reps: DataFrame, around: DataFrame, groups: DataFrame) -> DataFrame:
    """class, window, p: the pairs that heads may have left out, of texts in different clusters of `groups` (class, component).

    Rows of `around` have key, side, class, window. All texts of a key and side are paired if they are FEW; else all of an equal run of RUN shingles
    around the centre, as each pair with a passage there has, if these are FEW. In larger groups texts with a run of ENOUGH shingles in common, which is a passage whatever
    stands around it, are paired with one of them, and count as one cluster. Of the others each pair is compared that may have ENOUGH shingles near the centre in common, as each with a
    passage there has, however many texts hold them; texts that have a line in common and little else do not.
    """
    pair = F.struct("class", "window").alias("p"), F.col("component").alias("c")

    def parted(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        """All pairs of different components in groups of FEW rows or fewer, and the rows of larger groups."""
        many = rows.groupBy(*keys).agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x <> y").select(*keys, "n")
        rows = cut(rows.join(spread(many), keys), "passage-rest")
        few = rows.where(F.col("n") <= FEW)
        return few.join(spread(few.select(*keys, *pair)), keys).where("class < p.class AND component <> c").select("class", "window", "p"), rows.where(F.col("n") > FEW)

    held = around.select("key", "side", "class", "window").distinct()
    held = held.join(spread(groups), "class", "left").withColumn("component", F.coalesce("component", "class"))
    first, more = parted(held, ["key", "side"])
    near = cut(_surroundings(docs, reps, more.select("class", "window", "component")), "passage-surroundings")
    second, more = parted(near.select(F.explode("runs").alias("run"), "class", "window", "component"), ["run"])

    runs = near.where("size(enough) > 0").select(F.explode("enough").alias("run"), "class", "window", "component")
    top = runs.groupBy("run").agg(F.min(F.struct("component", "class", "window")).alias("top"), F.max("component").alias("y")).where("top.component <> y").drop("y")
    same = cut(runs.join(spread(top), "run").where("component <> top.component"), "passage-runs")
    third = same.select("class", "window", F.struct("top.class", "top.window").alias("p"))

    whole = components(same.select(F.col("component").alias("a"), F.col("top.component").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    more = more.select("class", "window", "component").distinct().join(spread(whole), "component", "left").select("class", "window", F.coalesce("whole", "component").alias("component"))
    near = near.select("key", "class", "window", "near").join(spread(cut(more, "passage-rest")), ["class", "window"])
    return first.unionByName(second).unionByName(third).unionByName(_overlapping(near, ENOUGH)).distinct()


def passages(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, partner_id, start_word, end_word, partner_start_word, similarity, cluster_id: near-duplicate passages of rows of docs (doc_id, text).

    A row for each passage (of `least` words or more) of a text and a partner that has it too, from either side. Equal texts are one class: each
    of its rows has a passage over its whole text with the class's smallest doc_id (the smallest with the next), and other passages are given for that
    row only. cluster_id: the smallest doc_id that is reachable through partners. Texts of fewer words, null and empty ones have none. Rows without a doc_id are classes' members, but not reported.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("class", F.xxhash64("text"))
    rows = cut(_counted(docs), "passage-rows").where(F.col("n") >= least)  # words are counted once
    reps = cut(rows.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("other"), F.max("n").alias("n")), "passage-classes")
    table = cut(window_table(docs), "passage-windows")  # read twice, and made once

    def heads(rows: DataFrame, *key: str) -> DataFrame:
        """The first class with its window of each key of two classes or more; aggregated before it is joined, so no task gets a key's rows."""
        return rows.groupBy(*key).agg(F.min(F.struct("class", "window")).alias("p"), F.max("class").alias("last"), F.count("*").alias("many")).where("p.class <> last").drop("last")

    shared = met = cut(table.join(cut(heads(table, "key"), "passage-keys"), "key"), "passage-met")
    drop_cut(table)
    sides = F.array(F.shiftright("context", 32).bitwiseAND((1 << 32) - 1), F.col("context").bitwiseAND((1 << 32) - 1).bitwiseOR(F.lit(1 << 32)))
    around = met.where("many > 2").select("key", "class", "window", F.explode(sides).alias("side"), F.col("p").alias("first"))
    met_too = around.join(heads(around, "key", "side"), ["key", "side"]).where("p <> first")
    met = met.select("class", "window", "p").unionByName(met_too.select("class", "window", "p")).where("class <> p.class")
    judged = _verified(docs, reps, met, least, "passages")
    groups = cut(components(judged.select("a", "b")).select(F.col("node").alias("class"), "component"), "passage-groups")
    late = _verified(docs, reps, rest(docs, reps, around, groups), least, "passages-rest")
    judged = judged.unionByName(late)
    joined = late.select("a", "b").distinct()
    for side in "ab":  # clusters that late passages join
        joined = joined.join(groups.select(F.col("class").alias(side), F.col("component").alias(f"c{side}")), side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    joined = components(joined.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    drop_cut(shared)
    members = reps.join(groups, "class", "left").withColumn("component", F.coalesce("component", "class"))
    members = members.join(joined, "component", "left").withColumn("component", F.coalesce("whole", "component")).drop("whole")
    first = members.groupBy("component").agg(F.min("doc_id").alias("cluster_id"))
    reps = cut(members.join(first, "component").drop("component"), "passage-clusters")
    x, y = (reps.select(F.col("class").alias(c), F.col("doc_id").alias(f"id_{c}"), *(["cluster_id"] if c == "a" else [])) for c in "ab")
    named = judged.join(x, "a").join(y, "b")
    length = F.col("end_word") - F.col("start_word")
    near = named.select(F.col("id_a").alias("doc_id"), F.col("id_b").alias("partner_id"), "start_word", "end_word", "partner_start_word", "similarity", "cluster_id")
    back = named.select(F.col("id_b").alias("doc_id"), F.col("id_a").alias("partner_id"), F.col("partner_start_word").alias("start_word"), (F.col("partner_start_word") + length).alias("end_word"), F.col("start_word").alias("partner_start_word"), "similarity", "cluster_id")
    same = rows.where("doc_id IS NOT NULL").join(reps.where("doc_id <> other").select("class", F.col("doc_id").alias("rep"), "other", "cluster_id"), "class")
    same = same.select("doc_id", F.when(F.col("doc_id") == F.col("rep"), F.col("other")).otherwise(F.col("rep")).alias("partner_id"), F.lit(0).cast("long").alias("start_word"), F.col("n").alias("end_word"), F.lit(0).cast("long").alias("partner_start_word"), F.lit(1.0).alias("similarity"), "cluster_id")
    return near.unionByName(back).unionByName(same).distinct()


_NAMES = ["a", "b", "start_word", "end_word", "partner_start_word", "similarity"]
_JUDGED = pa.schema([(n, pa.float64() if n == "similarity" else pa.int64()) for n in _NAMES])
