"""Mixing sources to target weights by balanced sampling with the cube method.

A source whose target is m times its size takes each of its documents floor(m) times, and once more with probability m - floor(m).
Which ones is chosen by the cube method: the vector of probabilities is moved through the null space of the constraints (sum of words,
number of documents) until all but a few entries are 0 or 1, so both totals stay what they were. The flight runs in blocks of a source;
two entries of a block at most stay fractional, and those of BLOCKS blocks meet in the next level, until one block per source is left.
There the landing drops the constraint on documents, then the one on words, rounds the last entry, and turns over one or two others
where that brings the total nearer.

Documents of more than GIANT of their source's target fly first. What they took is settled, and the others' probabilities are set to what
is left of the target; so the last entry rounded is short, and misses the target by GIANT / 2 at most.
"""

from __future__ import annotations

import bisect
import random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, n_words

BLOCK = 4096  # documents of a block
BLOCKS = 1024  # blocks whose leftovers meet in one block of the next level
MOST = 3.0  # times that a source may be taken
GIANT = 1 / 200  # share of a target beyond which a document flies first
SEED = 20240229


def targets(sums: DataFrame, most: float = MOST) -> DataFrame:
    """sums (source, source_size) with target, the words to take from each source.

    Sources by code point, null last, weigh 1, 2, 3, repeating. No target is above `most` times its source's size, and what is cut off is
    shared by weight among the others. Only the common share, a number, comes to the driver.
    """
    cells = cut(sums.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("_id", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("_id", 33)
    ahead = {r["part"]: r["n"] for r in cells.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row for each partition
    before, rows = 0, []
    for k in sorted(ahead):
        rows.append((k, before))
        before += ahead[k]
    at = cells.sparkSession.createDataFrame(rows, "_part long, _before long")
    order = F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)
    w = cells.withColumn("_part", part).join(at, "_part").withColumn("_w", (1 + order % 3).cast("double")).drop("_part", "_before", "_id")
    cap, fixed, share = most * F.col("source_size"), -1, 0.0
    total, weights = w.agg(F.sum(F.col("source_size").cast("double")), F.sum("_w")).first()
    share = (total or 0.0) / (weights or 1.0)
    while True:
        over = F.col("_w") * share > cap
        n, held, free = w.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("_w")))).first()
        if n == fixed or not free:
            break
        fixed, share = n, ((total or 0.0) - (held or 0.0)) / free
    return w.withColumn("target", F.least(cap, F.col("_w") * share)).drop("_w")


def flight(p: list[float], x: list[float], draw: random.Random, balance: int = 2) -> None:
    """Move the probabilities p in place until fewer than balance + 1 are fractional. balance 2: sums of p*x and of p stay; 1: of p*x."""
    tiny = 1e-9
    held: list[int] = []
    for i in range(len(p)):
        if not tiny < p[i] < 1 - tiny:
            p[i] = float(round(p[i]))
            continue
        held.append(i)
        while len(held) > balance:
            if balance == 2:
                a, b, c = held
                u = [x[b] - x[c], x[c] - x[a], x[a] - x[b]]
                if not any(u):
                    u = [1.0, -1.0, 0.0]
            else:
                a, b = held
                u = [x[b], -x[a]] if x[a] or x[b] else [1.0, 0.0]
            up = min((1 - p[k]) / d if d > 0 else p[k] / -d for k, d in zip(held, u, strict=True) if d)
            down = min(p[k] / d if d > 0 else (1 - p[k]) / -d for k, d in zip(held, u, strict=True) if d)
            step = up if draw.random() * (up + down) < down else -down
            for k, d in zip(held, u, strict=True):
                p[k] += step * d
                if not tiny < p[k] < 1 - tiny:
                    p[k] = float(round(p[k]))
            held = [k for k in held if 0 < p[k] < 1]


def land(p: list[float], x: list[float], draw: random.Random, up: float = 0.0, down: float = 0.0) -> None:
    """Fly, and round what is left. up, down: how many words the total may rise and fall by. Within both, the last entry is tossed for; else it
    goes to the side that is allowed, or to the nearer one, and then the one or two other entries are turned over that bring the total nearest."""
    free = [k for k, v in enumerate(p) if 0 < v < 1]
    flight(p, x, draw)
    flight(p, x, draw, 1)
    off = 0.0
    for k, v in enumerate(p):
        if 0 < v < 1:
            rise, fall = (1 - v) * x[k] <= up, v * x[k] <= down
            p[k] = float(draw.random() < v if rise and fall else rise if rise != fall else v >= 0.5)
            off += (p[k] - v) * x[k]
    beyond = lambda d: max(d - up, -down - d, 0.0)
    if not beyond(off):
        return
    turns = sorted((x[k] if p[k] == 0 else -x[k], k) for k in free if x[k])
    values, best = [d for d, _ in turns], (beyond(off), ())
    for i, (d, k) in enumerate(turns):
        j = bisect.bisect_left(values, -off - d)
        both = [(beyond(off + d + values[n]), (k, turns[n][1])) for n in (j - 1, j) if 0 <= n < len(turns) and n != i]
        best = min([best, (beyond(off + d), (k,)), *both], key=lambda b: b[0])
    for k in best[1]:
        p[k] = 1.0 - p[k]


def _fly(last: bool, seed: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending"), ("_h", "ascending"), ("_p", "ascending")])
        p, x = t.column("_p").to_pylist(), [float(v) for v in t.column("size").to_pylist()]
        draw = random.Random(f"{seed} {t.column('_block')[0]} {t.num_rows} {t.column('_h')[0]}")
        if not last:
            flight(p, x, draw)
        else:
            land(p, x, draw, t.column("_up")[0].as_py(), t.column("_down")[0].as_py())
        return t.set_column(t.schema.get_field_index("_p"), "_p", pa.array(p, pa.float64()))

    return run


def _flown(d: DataFrame, seed: int, block: int, name: str) -> DataFrame:
    """d (source, size, _h, _m, _n: rows of its source here, _up, _down) with _times, how often each row is taken."""
    blocks = F.greatest(F.ceil(F.col("_n") / block), F.lit(1))
    left = d.withColumns({"_base": F.floor("_m"), "_block": F.pmod("_h", blocks)}).withColumn("_p", F.col("_m") - F.col("_base"))
    most, levels, done = d.agg(F.max(blocks)).first()[0] or 1, 1, []
    while most > BLOCKS ** (levels - 1):
        levels += 1
    schema = left.schema
    for k in range(levels):
        flown = cut(left.groupBy("source", "_block").applyInArrow(_fly(k == levels - 1, seed), schema), f"mix-{name}{k}")
        done.append(flown if k == levels - 1 else flown.where("_p <= 0 OR _p >= 1"))
        left = flown.where("_p > 0 AND _p < 1").withColumn("_block", F.floor(F.col("_block") / BLOCKS))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.withColumn("_times", (F.col("_base") + F.col("_p")).cast("long"))


def mixed(docs: DataFrame, most: float = MOST, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken of each row of docs (doc_id, text, source).

    Null texts have no words; a null source is a source of its own; repeated rows are drawn one by one, and where one is repeated more often than
    a block's quarter its copies are dealt over blocks by their place in the table; an empty table gives no rows. A source all of whose
    documents are longer than what is wanted of it misses its target by what its last document is longer.
    """
    key = ["doc_id", "source", "size"]
    sized = cut(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), n_words(F.col("text").cast("string")).alias("size")), "mix-sizes")
    want = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), most), "mix-targets")
    often = cut(sized.groupBy(*key).agg(F.count("*").alias("_many")).where(F.col("_many") > block // 4), "mix-repeats")

    def same(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
        b = b.select(*(F.col(c).alias(f"_{c}") if c in names else F.col(c) for c in b.columns))
        on = F.lit(True)
        for c in names:
            on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return a.join(b, on, "left").drop(*(f"_{c}" for c in names))

    h = F.xxhash64(F.lit(seed), "doc_id", "size")
    d = same(same(sized.withColumn("_id", F.monotonically_increasing_id()), want, ["source"]), often, key)
    d = d.withColumn("_h", F.when(F.col("_many").isNull(), h).otherwise(F.xxhash64(h, "_id"))).drop("_many", "_id")
    d = cut(d.withColumn("_giant", F.col("size") > GIANT * F.col("target")), "mix-rows")
    giant, words = F.col("_giant"), F.col("size")
    per = d.groupBy("source").agg(F.count_if(giant).alias("_ng"), F.count_if(~giant).alias("_nr"), F.sum(F.when(~giant, words).otherwise(0)).alias("_rest"))
    d = same(d, cut(per, "mix-sums"), ["source"]).withColumn("_ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    room = F.col("_ratio") * F.col("_rest")  # what the others are to give: giants may take it too, or leave them all they can
    first = _flown(d.where("_giant").withColumns({"_m": F.col("_ratio"), "_n": F.col("_ng"), "_up": room, "_down": most * F.col("_rest") - room}), seed, block, "giants")
    got = cut(first.groupBy("source").agg(F.sum(F.col("size") * F.col("_times")).alias("_got")), "mix-got")
    rest = same(d.where("NOT _giant"), got, ["source"])
    m = F.when(F.col("_rest") > 0, F.greatest(F.lit(0.0), F.least(F.lit(most), (F.col("target") - F.coalesce("_got", F.lit(0))) / F.col("_rest")))).otherwise(0.0)
    second = _flown(rest.withColumns({"_m": m, "_n": F.col("_nr"), "_up": F.lit(0.0), "_down": F.lit(0.0)}).drop("_got"), seed, block, "rest")
    out = first.unionByName(second)
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("_times").alias("times"), (F.col("size") * F.col("_times")).alias("taken"))


def repeat(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as often as the mix takes them. doc_id is the key; rows with the same id are taken as their id's rows are on average, rounded up; a null id stays once."""
    t = mixed(docs, **how).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.ceil(F.avg("times")).cast("int").alias("_times"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    d = rows.join(t, "_id", "left").withColumn("_times", F.coalesce("_times", F.when(F.col("_id").isNull(), 1).otherwise(0)))
    return d.where("_times > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
