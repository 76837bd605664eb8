"""URL filters by a bit-parallel wildcard automaton (multiword Shift-And).

Glob patterns over canonical URLs (host and path) are packed into one bit vector of 64-bit words: a bit for each pattern's start and for
each of its literal bytes. Reading a byte shifts all states by one, keeps those whose next literal is that byte, and keeps states
before a wildcard that accepts it. All patterns advance at once, and so do all URLs of a batch (one row of words each).

`*` stands for any run of bytes but '/', `**` for any run of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textnum import raw

U = np.uint64

#: Rules of the query's contract: (verdict, host, path). A rule fits its host and all subdomains where the path begins with its path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
STATES = 4 << 20  # bytes of a table of states, at most (a row of words for each url of a slice)
#: Globs that decide where no rule fits: pages without prose of their own.
GLOBS = ("**/wp-login.php**", "**/cgi-bin/**", "**.exe", "**.zip", "**.css", "**.js")


class ShiftAnd:
    def __init__(self, globs: Sequence[str]):
        states: list[tuple[int, bool, int, bool, bool]] = []  # (byte or -1 for a start, last, pattern, loops, loops over '/')
        for k, g in enumerate(globs):
            b, i, own = g.encode(), 0, [[-1, False, k, False, False]]
            while i < len(b):
                if b[i] == 0x2A:
                    deep = b[i : i + 2] == b"**"
                    own[-1][3], own[-1][4] = True, own[-1][4] or deep
                    i += 1 + deep
                else:
                    own.append([b[i], False, k, False, False])
                    i += 1
            own[-1][1] = True
            states += map(tuple, own)
        self.words = (len(states) + 63) // 64
        self.start, self.last, self.step, self.loop = np.zeros(self.words, U), np.full(len(globs), 0), np.zeros((256, self.words), U), np.zeros((256, self.words), U)
        for s, (byte, last, k, loops, deep) in enumerate(states):
            w, bit = s // 64, U(1 << s % 64)
            if byte < 0:
                self.start[w] |= bit
            else:
                self.step[byte, w] |= bit
            if loops:
                self.loop[:, w] |= bit
                if not deep:
                    self.loop[0x2F, w] &= ~bit
            if last:
                self.last[k] = s

    def matches(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each string (bytes and where each begins), which patterns match it whole."""
        size = np.diff(at)
        order = np.argsort(-size, kind="stable")
        begin, size = at[:-1][order], size[order]
        d = np.tile(self.start, (len(order), 1))
        live = len(order)
        for i in range(int(size[0]) if len(size) else 0):
            if size[live - 1] <= i:
                live = int(np.searchsorted(-size, -i, "left"))
            c = data[begin[:live] + i]
            x = d[:live]
            moved = x << U(1)
            moved[:, 1:] |= x[:, :-1] >> U(63)
            d[:live] = (moved & self.step[c]) | (x & self.loop[c])
        hit = (d[:, self.last // 64] >> (self.last % 64).astype(U)) & U(1)
        out = np.zeros(hit.shape, bool)
        out[order] = hit.astype(bool)
        return out


def host_and_path() -> tuple[Column, Column]:
    """Of the column _url. Host: after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; path: from there up to '?', '#' or the end."""
    has = F.coalesce(F.instr("_url", "://") > 0, F.lit(False))
    rest = F.substring_index(F.substring_index(F.expr("substring(`_url`, instr(`_url`, '://') + 3)"), "#", 1), "?", 1)
    host = F.translate(F.substring_index(rest, "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.substring(rest, F.instr(rest, "/"), F.length(rest))
    return F.when(has, host).otherwise(""), F.when(has & (F.instr(rest, "/") > 0), path).otherwise("")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, globs: Sequence[str] = GLOBS) -> DataFrame:
    """page_id, host, path, rule, verdict of each row of pages (page_id, url; other columns are not read).

    The longest fitting rule decides (then block before allow, then their order); without one, a page is blocked if a glob matches.
    Null urls and those without '://' have empty host and path, and fit no rule. Repeated rows give repeated results. No shuffle.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    automaton = [x + h + p + "**" for _, h, p in ranked for x in ("", "*.")] + list(globs)
    names = pa.array([h + p for _, h, p in ranked] + [None])
    said = pa.array([v for v, _, _ in ranked] + ["allow", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = ShiftAnd(automaton)
        for whole in batches:
            step = max(1, STATES // (8 * auto.words))
            for k in range(0, whole.num_rows, step):
                b = whole.slice(k, step)
                hit = auto.matches(*raw(b.column("_canon")))
                n = len(ranked)
                fits = hit[:, 0 : 2 * n : 2] | hit[:, 1 : 2 * n : 2]
                rule = np.where(fits.any(1), fits.argmax(1) if n else 0, n)
                verdict = np.where(rule < n, rule, n + hit[:, 2 * n :].any(1))
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), names.take(pa.array(rule)), said.take(pa.array(verdict))], ["page_id", "host", "path", "rule", "verdict"])

    u = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("_url"))
    host, path = host_and_path()
    u = u.select("page_id", host.alias("host"), path.alias("path"))
    return u.withColumn("_canon", F.concat("host", "path")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
