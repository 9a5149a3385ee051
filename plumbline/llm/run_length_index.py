"""A run-length index: run-compressed Burrows-Wheeler transform with suffix-array samples at both ends of every run.

It answers matching statistics: for each position of a query, how long the longest match is that starts there, up to a
given length, and an occurrence of it. Queries are streamed from right to left, many at once.
"""

from __future__ import annotations

import numpy as np

#: Symbols of the indexed string: 0 ends it, 1 separates texts, bytes follow.
SEPARATOR, SHIFT = 1, 2
_PACKED = 7


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one string of symbols with a separator after each, and where each begins."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    body = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + SHIFT
    ends = np.cumsum(sizes)
    body[ends - 1] = SEPARATOR
    return np.append(body, np.uint16(0)), ends - sizes


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and for each sorted place the first place of an equal key."""
    order = np.argsort(keys, kind="stable")
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[order][1:] != keys[order][:-1]
    return order, np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))


def suffix_order(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array, and which sorted suffixes begin a class that shares its first `length` symbols.

    Prefix doubling: suffixes that are already told apart aren't sorted again.
    """
    n = len(symbols)
    keys = np.zeros(n, np.uint64)
    for j in range(_PACKED):
        keys <<= np.uint64(9)
        keys[: max(0, n - j)] |= symbols[j:].astype(np.uint64)
    order, first = _ranks(keys)
    rank = np.empty(n, np.int64)
    rank[order] = first
    classes, have = None, min(_PACKED, length)
    if length <= _PACKED:
        raise ValueError(f"classes need more than {_PACKED} symbols")
    while True:
        if have == length:
            classes = np.zeros(n, bool)
            classes[rank] = True
        tied = np.flatnonzero(_tied(rank[order]))
        if not len(tied):
            return order, classes if classes is not None else np.ones(n, bool)
        step = min(have, length - have) if have < length else have
        at = order[tied]
        second = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        keys = rank[at].astype(np.uint64) * np.uint64(n + 2) + second.astype(np.uint64)
        local, first = _ranks(keys)
        order[tied] = at[local]
        # the first tied place of each group of equal keys; ties are contiguous within their old group
        rank[at[local]] = tied[first]
        have += step


def _tied(sorted_ranks: np.ndarray) -> np.ndarray:
    same = np.zeros(len(sorted_ranks), bool)
    same[1:] = sorted_ranks[1:] == sorted_ranks[:-1]
    same[:-1] |= same[1:]
    return same


class RunLengthIndex:
    """An index of texts, each with an owner number; matches count up to `length` symbols."""

    def __init__(self, texts: list[bytes], owners: np.ndarray, length: int):
        self.length = length
        self.symbols, starts = joined(texts)
        order, classes = suffix_order(self.symbols, length)
        n = len(order)
        bwt = self.symbols[order - 1]
        heads = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])))
        self.run_start = heads
        self.run_end = np.append(heads[1:], n) - 1
        self.run_symbol = bwt[heads].astype(np.int64)
        self.first_sample, self.last_sample = order[self.run_start], order[self.run_end]
        sizes = self.run_end - self.run_start + 1
        self.run_of = np.repeat(np.arange(len(heads), dtype=np.int32), sizes)  # the run of each row
        self.by_symbol = np.argsort(self.run_symbol, kind="stable")
        # before each run, taken by symbol and then by place, stand all smaller symbols and its own earlier runs
        self.lf_base = np.empty(len(heads), np.int64)
        self.lf_base[self.by_symbol] = np.cumsum(sizes[self.by_symbol]) - sizes[self.by_symbol]
        self.symbol_key = self.run_symbol[self.by_symbol] * np.int64(len(heads) + 1) + self.by_symbol
        # the least owner of each class of suffixes that share `length` symbols
        self.class_start = np.flatnonzero(classes)
        owner_of = np.repeat(np.append(np.asarray(owners, np.int64), np.iinfo(np.int64).max), np.append(np.diff(np.append(starts, n - 1)), 1))
        self.class_owner = np.minimum.reduceat(owner_of[order], self.class_start)
        self.class_of = np.cumsum(classes, dtype=np.int32) - np.int32(1)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes from a and b share, up to `length`; places below 0 share none."""
        steps = np.arange(self.length)
        n = len(self.symbols)
        rows_a, rows_b = (self.symbols[np.minimum(x[:, None] + steps, n - 1)] for x in (np.maximum(a, 0), np.maximum(b, 0)))
        differ = rows_a != rows_b
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), self.length)
        return np.where((a < 0) | (b < 0), 0, shared)

    def least_owners(self, queries: list[bytes]) -> list[np.ndarray]:
        """For each position of each query, the least owner of a text that holds the `length` bytes from there.

        Where there is none, the greatest 64-bit integer stands.
        """
        found, begins = self.streamed(queries)
        return [found[a : a + len(q)] for a, q in zip(begins.tolist(), queries, strict=True)]

    def streamed(self, queries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same in one array, and where each query begins in it."""
        none = np.iinfo(np.int64).max
        sizes = np.array([len(q) for q in queries], np.int64)
        rank = np.argsort(-sizes, kind="stable")
        body = np.frombuffer(b"".join(queries[i] for i in rank), np.uint8).astype(np.int64) + SHIFT
        sizes = sizes[rank]
        begins = np.cumsum(sizes) - sizes
        found = np.full(len(body), none, np.int64)
        lanes = len(queries)
        row = np.zeros(lanes, np.int64)
        place = np.full(lanes, self.first_sample[0])
        match = np.zeros(lanes, np.int64)
        runs, shorter = len(self.run_start), -sizes
        for back in range(1, int(sizes[0]) + 1 if lanes else 1):
            live = int(np.searchsorted(shorter, -back, "right"))
            at = begins[:live] + sizes[:live] - back
            symbol = body[at]
            run = self.run_of[row[:live]]
            miss = np.flatnonzero(self.run_symbol[run] != symbol)
            match[:live] += 1
            place[:live] -= 1
            if len(miss):
                self._jump(miss, symbol[miss], run, row, place, match, runs)
            row[:live] = self.lf_base[run] + row[:live] - self.run_start[run]
            np.minimum(match[:live], self.length, out=match[:live])
            lost = match[:live] == 0
            if lost.any():
                row[:live][lost], place[:live][lost] = 0, self.first_sample[0]
            full = np.flatnonzero(match[:live] == self.length)
            if len(full):
                found[at[full]] = self.class_owner[self.class_of[row[full]]]
        first = np.empty(lanes, np.int64)
        first[rank] = begins
        return found, first

    def _jump(self, miss: np.ndarray, symbol: np.ndarray, run: np.ndarray, row: np.ndarray, place: np.ndarray, match: np.ndarray, runs: int) -> None:
        """Go on from the nearest run of the symbol, above or below, whose suffix shares more with the match so far."""
        key = symbol * np.int64(runs + 1) + run[miss]
        at = np.searchsorted(self.symbol_key, key)
        here = place[miss] + 1
        below = np.minimum(at, runs - 1)
        above = np.maximum(at - 1, 0)
        after, before = self.by_symbol[below], self.by_symbol[above]
        has_after = (at < runs) & (self.run_symbol[after] == symbol)
        has_before = (at > 0) & (self.run_symbol[before] == symbol)
        shared_after = self._common(np.where(has_after, self.first_sample[after], -1), here)
        shared_before = self._common(np.where(has_before, self.last_sample[before], -1), here)
        up = has_before & (~has_after | (shared_before >= shared_after))
        chosen = np.where(up, before, after)
        shared = np.where(up, shared_before, shared_after)
        row[miss] = np.where(up, self.run_end[chosen], self.run_start[chosen])
        place[miss] = np.where(up, self.last_sample[chosen], self.first_sample[chosen]) - 1
        match[miss] = np.where(has_after | has_before, np.minimum(match[miss] - 1, shared) + 1, 0)
        run[miss] = chosen
