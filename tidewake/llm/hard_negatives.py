"""Hard negatives by a secondary-sort shuffle.

Scores are inner products of integer vectors. Rows are dealt by a hash of their id into blocks that fit in a task, anchors (a stated set of
queries) go to every block, and a block scores the anchors as they stream past. Of its scores it keeps what can still count: for each
anchor the first positives, and for each of an anchor's windows the first negatives, since the first few of all rows are among the first few of
each block. What was kept is dealt by anchor and sorted there by (anchor, descending score, kind, id), and an iterator reads it once: the
rows of an anchor come best first, a positive opens its window, a negative is given out for each open window that its score is in, until that
window has enough. The iterator holds one anchor's open windows, never its rows.

Two passes, since windows depend on positives: the first finds each anchor's positives, the second its negatives. At equal scores
positives come first, so a window that its own positive's score is in (both zero) is open in time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut

BLOCK = 1 << 22  # components of the rows of a block, about
CELLS = 1 << 21  # scores that are held at once
EXACT = 1 << 53  # sums below it are exact in floating point


def _matrix(vectors: pa.ListArray, width: int = 0) -> np.ndarray:
    """The vectors as rows of integers; shorter ones are filled up with zeros."""
    values, many = vectors.flatten().to_numpy(zero_copy_only=False), vectors.value_lengths().to_numpy(zero_copy_only=False)
    width = max(width, int(many.max(initial=0)))
    if (many == width).all():
        return values.reshape(len(many), width)
    out = np.zeros((len(many), width), np.int64)
    out[np.arange(width)[None] < many[:, None]] = values
    return out


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b, exact: in floating point where no sum can leave its exact range, else in integers."""
    size = lambda x: max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    most = size(a) * size(b) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 1 << 62:
        raise ValueError("scores beyond 64 bits")
    return a @ b.T


def _first(scores: np.ndarray, use: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best usable scores of each row (all, if fewer), in the columns' order at equal scores."""
    none = np.iinfo(np.int64).min
    s = np.where(use, scores, none)
    if s.shape[1] > k:
        least = np.maximum(np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k], none + 1)
        row, col = np.nonzero(s >= least[:, None])
    else:
        row, col = np.nonzero(use)
    order = np.lexsort((col, -s[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


class _Block:
    """Rows of one block, by id: ids, labels and vectors."""

    def __init__(self, parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts)
        self.id, self.label = t.column("id").to_numpy(), t.column("label").to_numpy()
        self.vectors = _matrix(t.column("v").combine_chunks())
        order = np.argsort(self.id, kind="stable")
        self.id, self.label, self.vectors = self.id[order], self.label[order], self.vectors[order]

    def score(self, a: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """From and to which anchor of a, their scores with all rows, and which rows have their label."""
        v = _matrix(a.column("v"), self.vectors.shape[1])
        own = np.pad(self.vectors, ((0, 0), (0, v.shape[1] - self.vectors.shape[1])))
        label = a.column("label").to_numpy()
        step = max(1, CELLS // len(own))
        for i in range(0, len(v), step):
            yield i, min(i + step, len(v)), _scores(v[i : i + step], own), label[i : i + step, None] == self.label[None]


def _blocks(rows: DataFrame, anchors: DataFrame, blocks: int, found: Callable[[_Block, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """found(block, anchors) for each block of rows and all anchors, as they stream past. Both have id, label, v and what else found needs."""
    more = [c for c in anchors.columns if c not in ("id", "label", "v")]
    left = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "label", "v", *(F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in more))
    right = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "label", "v", *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        block, now = None, None
        for whole in batches:
            number, kind = whole.column("block").to_numpy(), whole.column("kind").to_numpy()
            cuts = np.flatnonzero(np.diff(number) | np.diff(kind)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(number)], strict=True):
                if i == j:
                    continue
                b = whole.slice(i, j - i)
                if number[i] != block:
                    parts, block, now = [], number[i], None
                if kind[i] == 0:
                    parts.append(b)
                elif parts or now:
                    now = now or _Block(parts)
                    parts = []
                    yield from found(now, b)

    return left.unionByName(right).repartition(blocks, "block").sortWithinPartitions("block", "kind", "id").mapInArrow(run, schema)


def _by_anchor(kept: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """The secondary sort: kept (anchor, score, kind, id) dealt by anchor, best first within it, and read once by run."""
    return kept.repartition("anchor").sortWithinPartitions("anchor", F.desc("score"), "kind", "id").mapInArrow(run, schema)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives for each positive of each anchor.

    rows: id (long), label, v (array<long>), each id once; anchors: those of them to find negatives for. An anchor's positives are its first
    `positives` other rows of its label, by descending score and then by id. For each, the first `negatives` rows of other labels count whose score is
    from `least` to `most` per cent of the positive's; all, if there are fewer. A positive with a negative score has no such range, so none.
    """
    bound_batches(rows.sparkSession)
    n, values = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0))).first()
    blocks = max(1, -(-values // BLOCK), min(rows.sparkSession.sparkContext.defaultParallelism, n // 64))
    kept = ["anchor", "score", "kind", "id"]

    def best(block: _Block, a: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = a.column("id").to_numpy()
        for i, j, s, same in block.score(a):
            row, col = _first(s, same & (ids[i:j, None] != block.id[None]), positives)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][row]), pa.array(s[row, col]), pa.array(np.zeros(len(row), np.int32)), pa.array(block.id[col])], kept)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, many = None, 0
        for b in batches:
            take = np.zeros(b.num_rows, bool)
            for k, x in enumerate(b.column("anchor").to_pylist()):
                anchor, many = x, many + 1 if x == anchor else 1
                take[k] = many <= positives
            yield b.select(kept).filter(pa.array(take))

    kind = "anchor long, score long, kind int, id long"
    chosen = cut(_by_anchor(_blocks(rows, anchors, blocks, best, kind), first, kind), "negatives-positives")
    windows = chosen.groupBy("anchor").agg(F.collect_set("score").alias("scores"))  # `positives` at most

    def within(block: _Block, a: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, scores = a.column("id").to_numpy(), _matrix(a.column("scores"), positives)
        many = a.column("scores").value_lengths().to_numpy()
        for i, j, s, same in block.score(a):
            rows_, cols = [], []
            for k in range(positives):
                p = scores[i:j, k, None]
                row, col = _first(s, ~same & (k < many[i:j])[:, None] & (least * p <= 100 * s) & (100 * s <= most * p), negatives)
                rows_.append(row)
                cols.append(col)
            at = np.unique(np.concatenate(rows_) * len(block.id) + np.concatenate(cols))
            row, col = at // len(block.id), at % len(block.id)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][row]), pa.array(s[row, col]), pa.array(np.ones(len(row), np.int32)), pa.array(block.id[col])], kept)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows = None, []  # windows: score, id and negatives so far
        names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for b in batches:
            out = []
            for x, score, what, id_ in zip(*(b.column(c).to_pylist() for c in kept), strict=True):
                if x != anchor:
                    anchor, windows = x, []
                if what == 0:
                    windows.append([score, id_, 0])
                    continue
                for w in windows:
                    if w[2] < negatives and least * w[0] <= 100 * score <= most * w[0]:
                        w[2] += 1
                        out.append((x, w[1], w[2], id_, w[0], score))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names)

    opened = anchors.join(windows, anchors["id"] == windows["anchor"]).drop("anchor")
    candidates = _blocks(rows, opened, blocks, within, kind)
    return _by_anchor(candidates.unionByName(chosen), stream, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def integer_rows(df: DataFrame, id: str, label: str, vector: str, scale: int = 256) -> DataFrame:
    """id, label, v of the rows of df that can take part, each component x as floor(scale * x).

    Rows with a null id, label or vector, or with any null or non-finite component, take no part. Of rows of one id, one takes part, the first by label
    and vector. Shorter vectors count as filled up with zeros. Scores must fit in 64 bits, else the job ends with an error.
    """
    x = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    clean = df.where(F.col(f"`{id}`").isNotNull() & F.col(f"`{label}`").isNotNull() & x.isNotNull() & finite)
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long"))
    whole = clean.select(F.col(f"`{id}`").cast("long").alias("id"), F.struct(F.col(f"`{label}`").cast("long").alias("label"), v.alias("v")).alias("_x"))
    return whole.groupBy("id").agg(F.min("_x").alias("_x")).select("id", "_x.label", "_x.v")
