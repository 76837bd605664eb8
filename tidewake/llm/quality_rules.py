"""Quality rules: statistics of each text by SQL functions, and a decision list learned from labelled statistics.

The list is learned by sequential covering: a conjunction of thresholds is grown on two thirds of the labelled rows by FOIL's gain,
pruned on the rest, and taken if it is precise enough there; the rows that it covers go, and the next one is grown. What is learned
becomes one ordered conditional expression (CASE WHEN ... THEN false ... ELSE true), so the scan of all rows stays inside the JVM.

Only fitting is bounded: by SAMPLE labelled rows, the first in the order of a hash of their id. Everything else covers whole texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut

SAMPLE = 20_000  # labelled rows that the list is fitted on, at most
BINS = 24  # thresholds tried for a feature, at most
PRECISION = 0.97  # least share of low-quality rows among the pruning rows that a rule covers
COVER = 3  # least number of pruning rows that a rule covers
RULES = 12  # rules in a list, at most
TERMS = 4  # conditions in a rule, at most
SYMBOLS = "#*$%&|<>"  # fixed value

#: Ratios the rules may use, from the columns that statistics() gives.
FEATURES = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
}


def _repeated(d: DataFrame, n: int) -> DataFrame:
    """d with n_repeat_words: how many words lie in runs of n words whose hash stands in _runs twice or more. _runs: the runs' hashes in order of place.

    Each step is a column of its own, so that none is computed twice; rows without a repeated hash skip them all.
    """
    order = F.sort_array(F.zip_with("_runs", F.sequence(F.lit(0), F.size("_runs") - 1), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.withColumn("_sorted", F.when(F.size(F.array_distinct("_runs")) < F.size("_runs"), order))
    d = d.withColumn("_h", F.transform("_sorted", lambda x: x["h"]))
    # a run is repeated if a neighbour in the order of hashes has its hash
    d = d.withColumn("_next", F.zip_with(F.slice("_h", 1, F.size("_h") - 1), F.slice("_h", 2, F.size("_h") - 1), lambda a, b: a == b))
    no = F.array(F.lit(False))
    d = d.withColumn("_twice", F.zip_with(F.concat(no, "_next"), F.concat("_next", no), lambda a, b: a | b))
    at = F.zip_with("_sorted", "_twice", lambda x, t: F.when(t, x["i"]))
    d = d.withColumn("_at", F.sort_array(F.filter(at, lambda x: x.isNotNull())))
    step = F.zip_with("_at", F.slice("_at", 2, F.size("_at")), lambda a, b: F.least(F.lit(n), F.coalesce(b - a, F.lit(n))))
    return d.withColumn("n_repeat_words", F.coalesce(F.aggregate(step, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("_sorted", "_h", "_next", "_twice", "_at")


def statistics(docs: DataFrame) -> DataFrame:
    """docs with the columns that the rules use, from whole texts; null and empty texts have zeros.

    Columns of docs with these names are replaced. A window's repeats are found by 64-bit hashes of its words, within a document.
    """
    window, text = 8, F.coalesce(F.col("_row.text").cast("string"), F.lit(""))
    # the row is one column, so no name of its own can clash with ours
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")).withColumn("_line", F.trim(F.regexp_replace(text, f"[{SPACE}]+", " ")))
    d = d.withColumn("_words", F.when(F.col("_line") == "", F.array().cast("array<string>")).otherwise(F.split("_line", " ")))
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    # hashes of runs of 1, 2, 4 and 8 words, each from two of the size before
    d, k = d.withColumn("_runs", F.when(F.col("n_words") > window, F.transform("_words", lambda w: F.xxhash64(w)))), 1
    while k < window:
        d = d.withColumn("_runs", F.zip_with(F.slice("_runs", 1, F.size("_runs") - k), F.slice("_runs", k + 1, F.size("_runs") - k), lambda a, b: F.xxhash64(a, b)))
        k *= 2
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    d = d.withColumn("_lines", lines)
    kept = lambda c, chars: F.length(F.regexp_replace(c, f"[^{chars}]+", "")).cast("long")
    d = _repeated(d, window).withColumn("_marks", F.regexp_replace(text, f"[^{SYMBOLS}A-Z!?]+", ""))
    found = {
        "n_words": F.col("n_words"),
        "word_chars": (F.length("_line") - F.greatest(F.col("n_words") - 1, F.lit(0))).cast("long"),
        "n_repeat_words": F.col("n_repeat_words"),
        "n_symbols": kept("_marks", SYMBOLS),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_upper": kept("_marks", "A-Z"),
        "n_marks": kept("_marks", "!?|"),
        "n_distinct_words": F.size(F.array_distinct("_words")).cast("long"),
    }
    own = [F.col(f"_row.`{c}`") for c in docs.columns if c not in found]
    return d.select(*own, *(c.alias(name) for name, c in found.items()))


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    cut: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.cut!r}D"


@dataclass(frozen=True)
class Rule:
    terms: tuple[Term, ...]
    covered: int
    right: int

    def sql(self) -> str:
        return " AND ".join(t.sql() for t in self.terms)


def _grow(cells: list[tuple], used: list[str], cuts: dict[str, list[float]]) -> list[tuple[int, bool, int]]:
    """Conditions (feature, above, bin), the best first, until only low-quality rows are left or nothing gains."""
    terms: list[tuple[int, bool, int]] = []
    while len(terms) < TERMS:
        bad, good = sum(c[-2] for c in cells), sum(c[-1] for c in cells)
        if not bad or not good:
            break
        base, best = math.log2(bad / (bad + good)), (0.0, None)
        for f, name in enumerate(used):
            b, g = [0] * (len(cuts[name]) + 1), [0] * (len(cuts[name]) + 1)
            for c in cells:
                b[c[f]] += c[-2]
                g[c[f]] += c[-1]
            sb = sg = 0
            for k in range(len(cuts[name])):
                sb, sg = sb + b[k], sg + g[k]
                for above, p, n in ((False, sb, sg), (True, bad - sb, good - sg)):
                    if p and (gain := p * (math.log2(p / (p + n)) - base)) > best[0] + 1e-9:
                        best = (gain, (f, above, k))
        if best[1] is None:
            break
        terms.append(best[1])
        cells = [c for c in cells if _fits(c, best[1])]
    return terms


def _fits(cell: tuple, term: tuple[int, bool, int]) -> bool:
    f, above, k = term
    return (cell[f] > k) == above


def learn(stats: DataFrame, label: str = "quality") -> list[Rule]:
    """An ordered list of rules under which a row is of low quality (label 0), from labelled statistics of at most SAMPLE rows.

    Spark bins the rows and counts them by cell; only these counts (a row for each distinct cell, SAMPLE at most) come to the driver.
    Rows whose label is null do not count. Without rows of both labels the list is empty.
    """
    used = list(FEATURES)
    s = stats.where(F.col(label).isNotNull()).select(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)).alias("part"), F.col(label).alias("label"), *(F.expr(f"cast({x} as double)").alias(f) for f, x in FEATURES.items()))
    marks = s.agg(*(F.percentile_approx(f, [k / BINS for k in range(1, BINS)], 10_000).alias(f) for f in used)).first()
    cuts = {f: sorted({float(x) for x in marks[f] or ()}) for f in used}
    bins = [sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)).alias(f) for f in used]
    rows = s.select("part", *bins, "label").groupBy("part", *used).agg(F.count_if(F.col("label") == 0).alias("bad"), F.count_if(F.col("label") != 0).alias("good")).collect()
    cells = sorted(tuple(r) for r in rows)
    grow, prune = [c[1:] for c in cells if c[0] != 0], [c[1:] for c in cells if c[0] == 0]
    out: list[Rule] = []
    while len(out) < RULES and (terms := _grow(grow, used, cuts)):
        value = []
        for n in range(1, len(terms) + 1):
            hit = [c for c in prune if all(_fits(c, t) for t in terms[:n])]
            p, m = sum(c[-2] for c in hit), sum(c[-1] for c in hit)
            value.append(((p - m) / (p + m) if p + m else -1.0, n, p, m))
        top, n, p, m = max(value, key=lambda v: (v[0], -v[1]))
        if p + m < COVER or p < PRECISION * (p + m):
            break
        rule = terms[:n]
        out.append(Rule(tuple(Term(used[f], above, cuts[used[f]][k]) for f, above, k in rule), p + m, p))
        grow, prune = ([c for c in part if not all(_fits(c, t) for t in rule)] for part in (grow, prune))
    return out


def verdict(rules: list[Rule]) -> Column:
    """The list as one conditional: false where a rule fits, tried in order; else true."""
    c = None
    for r in rules:
        c = (F if c is None else c).when(F.expr(r.sql()), F.lit(False))
    return F.lit(True) if c is None else c.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """A list learned on the labelled rows of docs. labels (doc_id, quality): repeated and null ids are left out once."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = cut(known, "quality-labels")
    stats = statistics(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")).drop("text")  # `sample` rows of 12 bytes at most
    return learn(cut(stats, "quality-sample"))


def quality(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with statistics, base_failed and kept. Null texts have no words, so they fail the base."""
    s = statistics(docs)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return s.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
