"""Suffix sorting by induction, with queues that spill to disk.

Suffixes are classed by whether they are smaller or larger than the next one. The leftmost ones of the smaller class are sorted first (by
name of the stretch up to the next such one; recursively where names repeat). Two scans then induce the rest: each takes
suffixes in order from a priority queue whose keys are first symbols, and puts the suffix before each of them back with its own symbol.
Since suffixes leave in order, those of one symbol are in order as they arrive, so the queue is a first-in-first-out run for each symbol, handled
a run at a time. Runs beyond a budget of memory go to a file that is deleted when closed.
"""

from __future__ import annotations

import tempfile

import numpy as np

from .textnum import U, gram_hashes, mix

MEMORY = 2 << 20  # bytes of a queue that stay in memory; the rest goes to disk
SYMBOLS = 4096  # most symbols for which induction by runs pays; larger alphabets are sorted by doubling


class RunQueue:
    """A priority queue over symbols: runs of suffix numbers, in the order in which they came."""

    def __init__(self, memory: int = MEMORY):
        self.runs: dict[int, list] = {}
        self.memory, self.held, self.file = memory, 0, None

    def push(self, symbol: int, run: np.ndarray) -> None:
        if self.held + run.nbytes > self.memory:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            at = self.file.tell()
            self.file.write(run.tobytes())
            self.runs.setdefault(symbol, []).append((at, len(run), run.dtype))
        else:
            self.held += run.nbytes
            self.runs.setdefault(symbol, []).append(run)

    def push_all(self, symbols: np.ndarray, values: np.ndarray) -> None:
        """Each value under its symbol; values of one symbol keep their order."""
        if not len(values):
            return
        order = np.argsort(symbols, kind="stable")
        s, v = symbols[order], values[order]
        cuts = np.flatnonzero(s[1:] != s[:-1]) + 1
        for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(s)], strict=True):
            self.push(int(s[x]), v[x:y])

    def pop(self, symbol: int) -> np.ndarray:
        out = []
        for r in self.runs.pop(symbol, []):
            if isinstance(r, tuple):
                self.file.seek(r[0])
                out.append(np.frombuffer(self.file.read(r[1] * r[2].itemsize), r[2]))
            else:
                self.held -= r.nbytes
                out.append(r)
        return np.concatenate(out) if len(out) > 1 else out[0] if out else np.zeros(0, np.int64)

    def close(self) -> None:
        if self.file:
            self.file.close()


def _induce(s: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, memory: int) -> np.ndarray:
    """All suffixes in order, from the leftmost smaller ones in order."""
    symbols = np.unique(s).tolist()
    ready, seeds = RunQueue(memory), RunQueue(memory)
    seeds.push_all(s[leftmost], leftmost)
    larger: dict[int, np.ndarray] = {}
    for c in symbols:
        parts, now = [], ready.pop(c)
        while len(now):
            parts.append(now)
            before = now[now > 0] - 1
            before = before[~smaller[before]]
            pc = s[before]
            now = before[pc == c]
            ready.push_all(pc[pc != c], before[pc != c])
        larger[c] = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        now = seeds.pop(c)
        before = now[now > 0] - 1
        ready.push_all(s[before], before)
    ready.close()
    seeds.close()
    ready, out = RunQueue(memory), []
    for c in reversed(symbols):
        parts, now = [], ready.pop(c)
        if c == symbols[0] and len(s) and s[-1] == c:
            now = np.concatenate((now, np.array([len(s) - 1])))
        while len(now):
            parts.append(now)
            before = now[now > 0] - 1
            before = before[smaller[before]]
            pc = s[before]
            now = before[pc == c]
            ready.push_all(pc[pc != c], before[pc != c])
        low = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        now = larger[c][::-1]
        before = now[now > 0] - 1
        before = before[smaller[before]]
        ready.push_all(s[before], before)
        out += [low, now]
    ready.close()
    return np.concatenate(out)[::-1]


def _double(s: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes in order of their first `depth` symbols at least, by doubling."""
    n, k = len(s), 1
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while k < depth:
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        k *= 2
    return order


def sort_suffixes(s: np.ndarray, depth: int | None = None, memory: int = MEMORY) -> np.ndarray:
    """The suffixes of s in order; s ends with a symbol smaller than all others, which stands nowhere else.

    depth: how many symbols must be in order (all if None); suffixes that agree on them stand together, in some order.
    """
    n = len(s)
    depth = depth or n
    if n < 3 or int(s.max()) > SYMBOLS:
        return _double(s, depth)
    step = np.sign(np.diff(s.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    smaller = np.append(step[np.minimum(at, n - 2)] > 0, True)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    # stretches from a leftmost place to the next one, both included, in order: induced from any order within a symbol
    first = _induce(s, smaller, leftmost, memory)
    mark = np.zeros(n, bool)
    mark[leftmost] = True
    order = first[mark[first]]
    number = np.full(n, -1, np.int64)
    number[leftmost] = np.arange(len(leftmost))
    end = np.append(leftmost[1:], n - 1) if len(leftmost) else leftmost
    size = end - leftmost + 1
    total = np.zeros(n + 1, U)
    power = np.cumprod(np.full(n, 0x9E3779B97F4A7C15, U), dtype=U)
    inverse = np.cumprod(np.full(n + 1, pow(0x9E3779B97F4A7C15, -1, 2**64), U), dtype=U)
    np.cumsum(mix(s.astype(U) + U(1)) * power, out=total[1:])
    name_of = mix((total[end + 1] - total[leftmost]) * inverse[leftmost]) ^ mix(size.astype(U))
    k = number[order]
    name = np.empty(len(leftmost), np.int64)
    name[k] = np.concatenate(([0], np.cumsum(name_of[k][1:] != name_of[k][:-1]))) if len(k) else k
    if len(k) and name[k[-1]] < len(k) - 1:
        order = leftmost[sort_suffixes(name, max(2, depth // 2 + 2), memory)]
    return _induce(s, smaller, order, memory)


def repeated_starts(texts: list[bytes], starts: list[int], size: int, memory: int = MEMORY) -> list[np.ndarray]:
    """For each text, which of its first `starts` places begin a string of `size` bytes that another of these places, in any text, begins too.

    All texts are sorted together. Neighbours in the order that agree on `size` bytes form a class; a class of two or more repeats.
    """
    gap = np.zeros(1, np.uint8)
    data = np.concatenate([x for t in texts for x in (np.frombuffer(t, np.uint8), gap)]) if texts else gap
    lens = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.concatenate(([0], np.cumsum(lens)))
    s = data.astype(np.int32) + 2
    s[begin[1:] - 1] = 1
    order = sort_suffixes(np.append(s, 0).astype(np.int32), size, memory)
    wanted = np.zeros(len(s) + 1, bool)
    for b, n, t in zip(begin[:-1].tolist(), starts, texts, strict=True):
        wanted[b : b + max(0, min(n, len(t) - size + 1))] = True
    order = order[wanted[order]]
    agree = gram_hashes(data, size)
    h = agree[order]
    same = h[1:] == h[:-1]
    hit = np.zeros(len(s) + 1, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return [hit[b : b + n] for b, n in zip(begin[:-1].tolist(), starts, strict=True)]
