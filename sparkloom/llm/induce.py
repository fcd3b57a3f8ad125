"""Suffix and common-prefix arrays by induced sorting with queues on disk (after Bingmann, Fischer and Osipov, 2013).

Suffixes that are smaller than their right neighbour while their left neighbour is larger (seeds) are sorted first: their substrings are
named by an induction of their own, and the string of names is sorted by the same means, recursively, until it fits in memory. From
the sorted seeds the larger suffixes are induced in ascending order and from these the smaller ones in descending order. An
induction is a monotone priority queue: one queue for each symbol, taken smallest (or largest) symbol first, whose entries come in
order. An entry is a suffix and the length it has in common with the entry before it; what is induced takes the smallest such
length between its two origins, plus one. Entries are moved in batches: all that a queue holds is one.

Queues keep little in memory: beyond `held` bytes their batches lie in a scratch file of the task, beside Spark's own spills, which has no name and ends
with the task. Common lengths count up to `limit`; suffixes that agree so far may stand in any order.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from collections.abc import Iterator

import numpy as np

Batch = tuple[np.ndarray, np.ndarray]


class Spill:
    """Arrays, in memory up to `held` bytes and in an unnamed file beyond."""

    def __init__(self, held: int):
        self.left, self.file, self.end = held, None, 0

    def put(self, x: np.ndarray):
        if x.nbytes <= self.left:
            self.left -= x.nbytes
            return x
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        self.file.seek(self.end)
        self.file.write(x.tobytes())
        self.end += x.nbytes
        return self.end - x.nbytes, len(x), x.dtype

    def take(self, handle) -> np.ndarray:
        if isinstance(handle, np.ndarray):
            self.left += handle.nbytes
            return handle
        at, n, dtype = handle
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * dtype.itemsize), dtype=dtype)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Queues:
    """One queue for each symbol; the smallest (sign 1) or largest (-1) symbol that has entries comes first."""

    def __init__(self, spill: Spill, sign: int = 1):
        self.spill, self.sign, self.of, self.heap = spill, sign, {}, []

    def put(self, symbol: int, at: np.ndarray, common: np.ndarray) -> None:
        if symbol not in self.of:
            self.of[symbol] = []
            heapq.heappush(self.heap, self.sign * symbol)
        self.of[symbol].append((self.spill.put(at), self.spill.put(common)))

    def first(self) -> int | None:
        return self.sign * self.heap[0] if self.heap else None

    def take(self, symbol: int) -> Batch | None:
        """All that the symbol's queue holds now; None if that is nothing, and the queue is done."""
        if symbol not in self.of:
            return None
        got = self.of[symbol]
        if not got:
            del self.of[symbol]
            self.heap.remove(self.sign * symbol)
            heapq.heapify(self.heap)
            return None
        self.of[symbol] = []
        parts = [(self.spill.take(a), self.spill.take(b)) for a, b in got]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


class Lows:
    """The smallest common length since any earlier entry of a sequence: the positions of suffix minima, `limit` + 1 of them at most."""

    def __init__(self):
        self.at, self.low, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def since(self, symbol_last: np.ndarray) -> np.ndarray:
        """Smallest length among the entries after each position (all of them lie before this batch); large if there is none."""
        k = np.searchsorted(self.at, symbol_last, side="right")
        return np.where(k < len(self.at), self.low[np.minimum(k, len(self.at) - 1)], 1 << 40) if len(self.at) else np.full(len(symbol_last), 1 << 40)

    def add(self, common: np.ndarray) -> None:
        tail = np.minimum.accumulate(common[::-1])[::-1].astype(np.int64)
        last = np.flatnonzero(np.concatenate([tail[1:] != tail[:-1], [True]]))
        keep = self.low < tail[0]
        self.at = np.concatenate([self.at[keep], last + self.n])
        self.low = np.concatenate([self.low[keep], tail[last]])
        self.n += len(common)


def _range_min(common: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Smallest of common[low + 1 : high + 1] for each pair."""
    out = np.empty(len(low), dtype=np.int64)
    gap, table, width = high - low, common, 1
    order = np.argsort(gap, kind="stable")
    upto = np.searchsorted(gap[order], [1 << j for j in range(1, int(gap.max(initial=1)).bit_length() + 1)])
    begin = 0
    for end in upto:
        some = order[begin:end]
        out[some] = np.minimum(table[low[some] + 1], table[high[some] + 1 - width])
        begin = end
        if begin < len(order):
            table = np.minimum(table[:-width], table[width:])
            width *= 2
    return out


class Induction:
    """One direction: what is induced goes to the queue of its first symbol."""

    def __init__(self, text: np.ndarray, smaller: np.ndarray, limit: int, spill: Spill, up: bool):
        self.text, self.smaller, self.limit, self.up = text, smaller, limit, up
        self.queues, self.lows, self.last = Queues(spill, 1 if up else -1), Lows(), {}

    def pass_on(self, at: np.ndarray, common: np.ndarray) -> None:
        """Entries of the sequence, in order; those whose left neighbour is of the induced kind (larger upwards, smaller downwards) bring it in."""
        before = at - 1
        can = np.flatnonzero((at > 0) & (self.smaller[before] != self.up))
        if len(can):
            symbol = self.text[before[can]]
            order = np.argsort(symbol, kind="stable")
            idx, symbol = can[order], symbol[order]
            new = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
            shared = np.zeros(len(idx), dtype=np.int64)
            inner = np.ones(len(idx), dtype=bool)
            inner[new] = False
            k = np.flatnonzero(inner)
            if len(k):
                shared[k] = _range_min(common, idx[k - 1], idx[k]) + 1
            heads = symbol[new].tolist()
            least = np.minimum.accumulate(common)[idx[new]]
            known = np.array([self.last.get(s, -1) for s in heads], dtype=np.int64)
            shared[new] = np.where(known < 0, 0, np.minimum(self.lows.since(known), least) + 1)
            shared = np.minimum(shared, self.limit).astype(np.int16)
            ends = np.append(new[1:], len(idx))
            for s, a, b in zip(heads, new.tolist(), ends.tolist()):
                self.last[s] = self.lows.n + int(idx[b - 1])
                self.queues.put(s, before[idx[a:b]], shared[a:b])
        self.lows.add(common)


def _kinds(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its right neighbour; the last one, the end mark, is."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    nxt = np.searchsorted(differs, np.arange(n - 1))
    out = np.ones(n, dtype=bool)
    out[:-1] = text[differs[nxt]] < text[differs[nxt] + 1]
    return out


def _induce(text: np.ndarray, smaller: np.ndarray, runs: np.ndarray, seeds: Iterator[tuple[int, np.ndarray, np.ndarray]], limit: int, held: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """Yields (kind, suffixes, common lengths) from the largest to the smallest, each batch in descending order; a length is what an entry
    shares with the one before it in the batch sequence, that is the next larger one."""
    spill = Spill(held)
    up = Induction(text, smaller, limit, spill, True)
    waiting = Queues(spill)
    for symbol, at, common in seeds:
        waiting.put(symbol, at, common)
    larger: dict[int, list] = {}
    while (symbols := [s for s in (up.queues.first(), waiting.first()) if s is not None]) != []:
        symbol, last = min(symbols), None
        while (got := up.queues.take(symbol)) is not None:
            larger.setdefault(symbol, []).append((spill.put(got[0]), spill.put(got[1])))
            up.pass_on(*got)
            last = got[0][-1]
        while (got := waiting.take(symbol)) is not None:
            at, common = got
            if last is not None:  # the last larger and the first smaller suffix of a symbol share the shorter of their runs of it
                common = common.copy()
                common[0] = min(runs[last], runs[at[0]], limit)
                last = None
            up.pass_on(at, common)
    down = Induction(text, smaller, limit, spill, False)
    while larger or down.queues.first() is not None:
        symbol, last = max([*larger.keys(), *([down.queues.first()] if down.queues.first() is not None else [])]), None
        while (got := down.queues.take(symbol)) is not None:
            yield True, *got
            down.pass_on(*got)
            last = got[0][-1]
        batches, following = larger.pop(symbol, []), None
        parts = [(spill.take(a), spill.take(b)) for a, b in reversed(batches)]
        for at, common in parts:
            # lengths are with the smaller neighbour there; here each goes to that neighbour, which comes after
            at, common = at[::-1], common[::-1]
            shared = np.concatenate([[0 if following is None else following], common[:-1]]).astype(np.int16)
            if last is not None:
                shared[0] = min(runs[last], runs[at[0]], limit)
                last = None
            following = common[-1]
            yield False, at, shared
            down.pass_on(at, shared)
    yield True, np.array([len(text) - 1]), np.zeros(1, dtype=np.int16)  # nothing brings the end mark in
    spill.close()


def _grouped(text: np.ndarray, at: np.ndarray, common: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Seeds by their first symbol, in their order."""
    symbol = text[at]
    order = np.argsort(symbol, kind="stable")
    symbol = symbol[order]
    new = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]])) if len(at) else np.zeros(0, int)
    for a, b in zip(new.tolist(), np.append(new[1:], len(at)).tolist()):
        yield int(symbol[a]), at[order[a:b]], common[order[a:b]]


def _agree(text: np.ndarray, a: np.ndarray, b: np.ndarray, start: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """How far the suffixes at a and b agree, from `start` (up to where they do) to `upto`."""
    out, left = start.astype(np.int64).copy(), np.flatnonzero(start < upto)
    while len(left):
        x, y = a[left] + out[left], b[left] + out[left]
        same = (np.maximum(x, y) < len(text)) & (text[np.minimum(x, len(text) - 1)] == text[np.minimum(y, len(text) - 1)])
        left = left[same]
        out[left] += 1
        left = left[out[left] < upto[left]]
    return out


def _doubled(names: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common lengths with the one before) of a string that fits in memory, for `limit` symbols at least."""
    n, width = len(names), 1
    rank = np.append(np.unique(names, return_inverse=True)[1] + 1, 0)
    levels = [rank]
    while width < limit and rank.max() < n:
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: max(0, n - width)] = rank[width:n]
        rank = np.append(np.unique(rank[:n] * np.int64(n + 1) + ahead, return_inverse=True)[1] + 1, 0)
        levels.append(rank)
        width *= 2
    order = np.argsort(rank[:n], kind="stable")
    common = np.zeros(n, dtype=np.int64)
    a, b = order[:-1], order[1:]
    for j in range(len(levels) - 1, -1, -1):
        step = 1 << j
        while True:
            x, y = a + common[1:], b + common[1:]
            same = (np.maximum(x, y) < n) & (common[1:] < limit)
            same[same] = levels[j][x[same]] == levels[j][y[same]]
            # below the top level a step is made once at most, unless it leads past what was sorted
            if not same.any():
                break
            common[1:][same] += step
    return order, np.minimum(common, limit)


def suffixes(text: np.ndarray, limit: int, memory: int, held: int) -> Iterator[Batch]:
    """(suffixes, lengths in common with the one before, up to limit) in batches, from the largest suffix to the smallest.

    text: symbols that end with a 0 which is nowhere else. memory: symbols of a string of names that are sorted at once; held: bytes
    that queues keep.
    """
    n, smaller = len(text), _kinds(text)
    change = np.flatnonzero(np.concatenate([text[1:] != text[:-1], [True]]))
    runs = np.minimum(change[np.searchsorted(change, np.arange(n))] + 1 - np.arange(n), limit).astype(np.int16)
    seeds = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(seeds) > 1:
        seed = np.zeros(n, dtype=bool)
        seed[seeds] = True
        # names: seeds in any order of their first symbols induce the order of the substrings between seeds
        zero = np.zeros(len(seeds), dtype=np.int16)
        order = np.concatenate([at[seed[at]] for kind, at, _ in _induce(text, smaller, runs, _grouped(text, seeds, zero), limit, held) if kind])[::-1]
        end = np.append(seeds[1:], n - 1)
        length = np.zeros(n, dtype=np.int64)
        length[seeds] = end - seeds + 1
        size = length[order]
        same = np.zeros(len(order), dtype=bool)
        pairs = np.flatnonzero(size[1:] == size[:-1])
        agreed = _agree(text, order[pairs], order[pairs + 1], np.zeros(len(pairs), dtype=np.int64), size[pairs])
        same[pairs[agreed == size[pairs]] + 1] = True
        name = np.cumsum(~same)
        by_seed = np.empty(len(seeds), dtype=np.int64)
        by_seed[np.searchsorted(seeds, order)] = name
        names = limit // 2 + 1  # seeds are two symbols apart at least
        if len(seeds) <= memory:
            ranked, common = _doubled(by_seed, names)
        else:
            parts = list(suffixes(np.append(by_seed, 0), names, memory, held))
            ranked, common = (np.concatenate(x) for x in zip(*parts))
            # turned round: lengths are with the next smaller one again; the end mark's own suffix goes
            ranked, common = ranked[::-1], np.append(0, common[::-1][:-1])
            ranked, common = ranked[1:], common[1:]
        at = seeds[ranked]
        shared = np.zeros(len(at), dtype=np.int64)
        a, b, r = ranked[:-1], ranked[1:], common[1:].astype(np.int64)
        # as many names in common are as many symbols as lie between their seeds; the rest is compared
        whole = np.append(seeds, n)
        start = np.minimum(whole[np.minimum(a + r, len(seeds))] - seeds[a], limit)
        shared[1:] = _agree(text, at[:-1], at[1:], start, np.full(len(start), limit))
        seeds, shared = at, shared.astype(np.int16)
    else:
        shared = np.zeros(len(seeds), dtype=np.int16)
    for _, at, common in _induce(text, smaller, runs, _grouped(text, seeds, shared), limit, held):
        yield at, common


def repeated(texts: list[bytes], window: int, memory: int, held: int) -> np.ndarray:
    """For the texts' bytes, one after another with one symbol more after each: whether a string of `window` bytes starts there that starts
    elsewhere too."""
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint16) + 2
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    text = np.append(np.insert(flat, ends, 1), 0).astype(np.uint16)
    out = np.zeros(len(text), dtype=bool)
    before = None
    for at, common in suffixes(text, window, memory, held):
        hit = common >= window
        out[at[hit]] = True
        # the larger neighbour too, which may have come with the batch before
        out[at[:-1][hit[1:]]] = True
        if hit[0] and before is not None:
            out[before] = True
        before = at[-1]
    # a common prefix that runs over an end isn't one of bytes
    ok = np.zeros(len(text), dtype=bool)
    for begin, end in zip((ends - [len(t) for t in texts]) + np.arange(len(texts)), ends + np.arange(len(texts))):
        ok[begin : max(begin, end - window + 1)] = True
    return (out & ok)[:-1]
