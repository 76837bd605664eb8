"""Small tables with the cases every operator must take: nulls, empty and long texts, ties, repeated rows, extra columns."""

from __future__ import annotations

import random

WORDS = [a + b for a in ("ba", "ko", "mi", "tu", "re", "lo", "sha", "vi", "pe", "du") for b in ("n", "la", "rit", "so", "mek", "dor", "gu", "fa")]


def prose(rng: random.Random, n: int) -> str:
    out = []
    for k in range(n):
        out.append(rng.choice(WORDS) + rng.choice(["", "", "", ".", ","]))
        out.append("\n" if k % 17 == 16 else " ")
    return "".join(out)


def corpus(seed: int = 0) -> list[tuple]:
    """doc_id, text, lang, source, n_chars and two columns whose names operators use themselves."""
    rng = random.Random(seed)
    texts: list[str | None] = [prose(rng, rng.randint(30, 160)) for _ in range(24)]
    base, passage = texts[0], prose(rng, 90)
    texts += [base, base, base.replace("ba", "bo", 1), base + " tail words here", texts[1].upper()]
    texts += [prose(rng, 40) + passage + prose(rng, 40), prose(rng, 35) + passage + prose(rng, 50), passage]
    texts += [None, "", " \n\t ", "one", "two words", "ß漢😀 " * 30, prose(rng, 9000)]
    rows = [(k, t, "en", [None, "a", "b", "é"][k % 4], len(t or ""), k % 3, "x") for k, t in enumerate(texts)]
    return [*rows, rows[3]]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _h int, class string"


def frame(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, SCHEMA)


def words(text, lower=True):
    import re

    t = (text or "").translate({k: k + 32 for k in range(65, 91)}) if lower else text or ""
    return re.findall("[^\x20\x09-\x0d]+", t)
