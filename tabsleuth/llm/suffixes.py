"""Suffix arrays of byte strings by induced sorting on whole arrays."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int):
        if len(self.up) < n:
            size = 1 << int(n).bit_length()
            for name, b in (("up", _BASE), ("down", _BASE_INV)):
                p = np.full(size, np.uint64(b))
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))
        return self.up, self.down


_POWERS = _Powers()


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of the ``length`` bytes from each position on, where there are as many."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _POWERS.upto(len(data))
    head = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], dtype=np.uint64)])
    return (head[length:] - head[:n]) * down[:n]


def _types(t: np.ndarray) -> np.ndarray:
    """True for the suffixes that are smaller than the next one (S); the last one is not."""
    n = len(t)
    change = np.flatnonzero(t[1:] != t[:-1])
    ends = np.append(change, n - 1)                       # last place of each run of equal bytes
    rises = np.append(t[change] < t[change + 1], False)
    return np.repeat(rises, np.diff(np.concatenate([[-1], ends])))


def _name(t: np.ndarray, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Ranks of the substrings from one leftmost-smaller place to the next, both included.

    Symbols hold byte and type, so that no substring is a prefix of another one.
    Seven symbols fill a number; longer substrings are ranked further by their next seven."""
    n = len(t)
    symbol = np.concatenate([(t.astype(np.uint64) << np.uint64(1) | small) + np.uint64(1), np.zeros(8, np.uint64)])
    length = np.append(np.diff(lms) + 1, n - lms[-1])
    rank = np.zeros(len(lms), np.int64)
    active, at = np.arange(len(lms)), 0
    while len(active):
        word = np.zeros(len(active), np.uint64)
        for j in range(7):
            here = np.where(at + j < length[active], symbol[np.minimum(lms[active] + at + j, n)], np.uint64(0))
            word = (word << np.uint64(9)) | here
        order = np.lexsort((word, rank[active]))
        r, w = rank[active][order], word[order]
        new = np.concatenate([[False], (r[1:] != r[:-1]) | (w[1:] != w[:-1])])
        # Ranks count places, so that refining one leaves room between it and the next.
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        place = np.arange(len(r))
        group = np.zeros(len(r), np.int64)
        group[first] = first
        group = np.maximum.accumulate(group)
        start = np.maximum.accumulate(np.where(new | (place == group), place, 0))
        rank[active[order]] = r + (start - group)
        at += 7
        tied = np.zeros(len(r), bool)
        same = (r[1:] == r[:-1]) & (w[1:] == w[:-1])
        tied[1:] |= same
        tied[:-1] |= same
        more = active[order[tied]]
        active = np.sort(more[length[more] > at])
    return rank


def _sort_lms(t: np.ndarray, small: np.ndarray, lms: np.ndarray, depth: int) -> np.ndarray:
    """Leftmost-smaller places in the order of their suffixes, as far as ``depth`` bytes tell.

    The string of the ranks is sorted by doubling: its alphabet is as long as itself."""
    rank = _name(t, small, lms)
    _, rank = np.unique(rank, return_inverse=True)
    step, n = 1, len(lms)
    while rank.max() < n - 1:
        if step >= n or (lms[step:] - lms[:-step]).min() >= depth:
            break
        follow = np.zeros(n, np.int64)
        follow[:-step] = rank[step:] + 1
        _, rank = np.unique(rank * np.int64(n + 1) + follow, return_inverse=True)
        step *= 2
    return lms[np.argsort(rank, kind="stable")]


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``t`` (uint8) sorted by their suffixes, at least as far as ``depth`` bytes.

    Leftmost-smaller suffixes are sorted first.  The others are induced from
    them a bucket (first byte) at a time: from the smallest byte up, each
    sorted bucket hands its predecessors that are larger than their successor
    to their buckets, in order; from the largest byte down the smaller ones.
    Predecessors in the same bucket follow in waves."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    by_byte: dict[int, np.ndarray] = {}
    if len(lms):
        ordered = _sort_lms(t, small, lms, depth)
        bytes_ = t[ordered]
        cuts = np.flatnonzero(np.diff(bytes_)) + 1
        by_byte = {int(t[p[0]]): p for p in np.split(ordered, cuts)}
    present = np.flatnonzero(np.bincount(t, minlength=256))

    def induce(bytes_in_order, seed, wanted, beside, after):
        """Buckets of one type; ``beside`` gives the other type's part of a bucket, read after its own."""
        waiting: dict[int, list] = {int(c): [] for c in bytes_in_order}
        for c, p in seed:
            waiting[c].append(p)
        done = {}
        for c in map(int, bytes_in_order):
            parts = [np.concatenate(waiting[c])] if waiting[c] else []
            wave = parts[0] if parts else np.zeros(0, np.int64)
            while len(wave):
                before = wave[wave > 0] - 1
                wave = before[(t[before] == c) & (small[before] == wanted)]
                if len(wave):
                    parts.append(wave)
            done[c] = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            source = np.concatenate([done[c], beside(c)])
            before = source[source > 0] - 1
            before = before[(small[before] == wanted) & after(t[before], c)]
            if len(before):
                first = t[before]
                order = np.argsort(first, kind="stable")
                first, before = first[order], before[order]
                for p in np.split(before, np.flatnonzero(np.diff(first)) + 1):
                    waiting[int(t[p[0]])].append(p)
        return done

    none = np.zeros(0, np.int64)
    larger = induce(present, [(int(t[-1]), np.array([n - 1]))], False, lambda c: by_byte.get(c, none), lambda x, c: x > c)
    smaller = induce(present[::-1], [], True, lambda c: larger[c][::-1], lambda x, c: x < c)
    return np.concatenate([p for c in map(int, present) for p in (larger[c], smaller[c][::-1])])


def reaching(t: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """By text position: whether the common prefix with the suffix before it in the array has ``length``
    bytes (the permuted common prefixes, as far as they matter)."""
    h = window_hashes(t, length)
    before = np.full(len(t), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(len(t), bool)
    i = np.flatnonzero((before[:len(h)] >= 0) & (before[:len(h)] < len(h)))
    out[i] = h[i] == h[before[i]]
    return out
