"""Suffix arrays of integer sequences in numpy: Larsson-Sadakane refinement, common prefixes
after Kasai, and lookup by binary search. All of it works on one bounded shard inside a task."""

from __future__ import annotations

import numpy as np


def pack(symbols: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """Each position's next 62 // bits symbols as one integer, and how many that are; symbols beyond the end count as 0."""
    h = max(1, 62 // bits)
    key = np.zeros(len(symbols), np.int64)
    for i in range(h):
        key <<= bits
        if i < len(key):
            key[: len(key) - i] |= symbols[i:]
    return key, h


def suffix_array(symbols: np.ndarray, bits: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(sa, rank) of the suffixes in the order of their first `depth` symbols at least.

    Ranks start from packed symbols; each round doubles the sorted depth and sorts anew only the
    groups of suffixes that are still equal, by (own rank, rank of the suffix h further on)."""
    key, h = pack(symbols, bits)
    n = len(symbols)
    sa = np.argsort(key)
    key = key[sa]
    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    place = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = place
    alone = fresh & np.append(fresh[1:], True)
    open_ = np.flatnonzero(~alone)
    while h < depth and len(open_):
        suf = sa[open_]
        after = suf + h
        key = (rank[suf] << 31) | np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key)
        suf, key = suf[order], key[order]
        sa[open_] = suf
        fresh = np.ones(len(open_), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[suf] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(open_)), 0))]
        open_ = open_[~(fresh & np.append(fresh[1:], True))]
        h *= 2
    return sa, rank


def bytes_at(padded: np.ndarray) -> np.ndarray:
    """Eight bytes from each position as one integer; `padded` has eight bytes more than there are positions."""
    n = len(padded) - 8
    out = np.zeros(n, np.uint64)
    for i in range(8):
        out |= padded[i : i + n].astype(np.uint64) << np.uint64(8 * i)
    return out


def common_prefixes(eight: np.ndarray, before: np.ndarray, lanes: list[tuple[int, int]], most: int) -> np.ndarray:
    """Kasai's scan over several lanes at once: common prefix length, `most` at the most, of position p and before[p].

    before: the predecessor of each position among the sorted suffixes, -1 for none. lanes: ranges of
    positions; each lane walks its positions in text order and keeps the length less one whenever the
    predecessor of p - 1 moved one on is itself a sorted suffix. eight: bytes_at() of the text."""
    out = np.zeros(len(before), np.int32)
    if not lanes:
        return out
    lane = np.array(sorted(lanes, key=lambda x: x[0] - x[1]), np.int64)
    size = lane[:, 1] - lane[:, 0]
    held = np.zeros(len(lane), np.int64)
    for step in range(int(size[0])):
        live = int(np.searchsorted(-size, -step, "left"))
        p = lane[:live, 0] + step
        q = before[p]
        h = held[:live]
        if step:
            kept = before[p - 1]
            ok = (kept >= 0) & (kept + 1 < len(before)) & (before[np.minimum(kept + 1, len(before) - 1)] > -2)
            h = np.where(ok, np.maximum(h - 1, 0), 0)
        h = np.where(q >= 0, h, 0)
        todo = np.flatnonzero((q >= 0) & (h < most))
        while len(todo):
            differ = eight[p[todo] + h[todo]] ^ eight[q[todo] + h[todo]]
            same = differ == 0
            end = todo[~same]
            low = differ[~same]
            low &= ~low + np.uint64(1)  # the lowest bit in which they differ
            h[end] += np.log2(low.astype(np.float64)).astype(np.int64) >> 3
            todo = todo[same]
            h[todo] += 8
            todo = todo[h[todo] < most]
        h = np.minimum(h, most)
        out[p] = h
        held[:live] = h
    return out


def find(symbols: np.ndarray, sa: np.ndarray, patterns: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 place in sa of the suffixes that begin with each pattern (rows of `patterns`, `size` symbols of it)."""
    width = patterns.shape[1]
    padded = np.concatenate((symbols, np.full(width, -1, symbols.dtype)))
    inside = np.arange(width) < size[:, None]
    out = []
    for upper in (False, True):
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(sa), np.int64)
        while True:
            busy = np.flatnonzero(lo < hi)
            if not len(busy):
                break
            mid = (lo[busy] + hi[busy]) >> 1
            text = padded[sa[mid][:, None] + np.arange(width)]
            differ = (text != patterns[busy]) & inside[busy]
            at = differ.argmax(axis=1)
            row = np.arange(len(busy))
            equal = ~differ[row, at]
            less = np.where(equal, upper, text[row, at] < patterns[busy, at])
            lo[busy] = np.where(less, mid + 1, lo[busy])
            hi[busy] = np.where(less, hi[busy], mid)
        out.append(lo)
    return out[0], out[1]
