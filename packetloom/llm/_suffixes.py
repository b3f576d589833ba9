"""Suffix arrays by induced sorting, on NumPy arrays.

Suffixes are classified (S: smaller than the next suffix, L: larger). The leftmost-smaller
suffixes' substrings are sorted by inducing, named, and where names repeat the names are
sorted by a further round; from their order all suffixes are induced in two linear scans.
A scan handles a whole bucket at once: what a bucket induces into itself comes in waves,
as many as its letter repeats in a row.
"""

from __future__ import annotations

import numpy as np


def _smaller(text: np.ndarray) -> np.ndarray:
    """S-type flags; the last suffix is L, as the empty one is smaller."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(np.diff(text.astype(np.int64)))
    step[-1] = -1
    # a run of equal letters takes the type of what follows it
    where = np.where(step != 0, np.arange(n), n)
    where = np.minimum.accumulate(where[::-1])[::-1]
    return step[where] > 0


class _Buckets:
    def __init__(self, text: np.ndarray, smaller: np.ndarray, letters: int):
        self.text, self.smaller, self.letters = text.astype(np.uint16), smaller, letters

    def _deal(self, to: list[list[np.ndarray]], items: np.ndarray) -> None:
        if len(items):
            letter = self.text[items]
            order = np.argsort(letter, kind="stable")
            items, letter = items[order], letter[order]
            cut = np.flatnonzero(np.diff(letter)) + 1
            for part in np.split(items, cut):
                to[self.text[part[0]]].append(part)

    def induce(self, seeds: np.ndarray) -> np.ndarray:
        """All suffixes in order, from leftmost-smaller suffixes in order (or in any order:
        then ordered by their substrings)."""
        n = len(self.text)
        seed: list[list[np.ndarray]] = [[] for _ in range(self.letters)]
        self._deal(seed, seeds)
        larger: list[list[np.ndarray]] = [[] for _ in range(self.letters)]
        larger[self.text[n - 1]].append(np.array([n - 1]))
        for c in range(self.letters):
            self._scan(larger, c, ~self.smaller)
            if seed[c]:
                before = np.concatenate(seed[c]) - 1
                self._deal(larger, before[before >= 0])
        small: list[list[np.ndarray]] = [[] for _ in range(self.letters)]  # from right to left
        for c in range(self.letters - 1, -1, -1):
            self._scan(small, c, self.smaller)
            if larger[c]:
                before = larger[c][0][::-1] - 1
                before = before[before >= 0]
                self._deal(small, before[self.smaller[before]])
        out = []
        for c in range(self.letters):
            out += larger[c]
            out += [p[::-1] for p in small[c]]
        return np.concatenate(out)

    def _scan(self, to: list[list[np.ndarray]], c: int, kind: np.ndarray) -> None:
        """Deals what bucket c induces; what it induces into itself comes behind, in waves."""
        if not to[c]:
            return
        wave = np.concatenate(to[c])
        waves = [wave]
        while len(wave):
            before = wave - 1
            before = before[before >= 0]
            before = before[kind[before]]
            same = self.text[before] == c
            self._deal(to, before[~same])
            wave = before[same]
            waves.append(wave)
        to[c] = [np.concatenate(waves)]


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a text over many letters."""
    rank, step = names.astype(np.int64), 1
    n = len(rank)
    while True:
        key = rank * (n + 2)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank, step = new, 2 * step
        if rank[order[-1]] == n - 1 or step >= n:
            return order


#: A text of names over so many letters at most is sorted by inducing again.
LETTERS = 1024


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of a text of small non-negative integers, in order."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    text = text.astype(np.int64)
    letters = int(text.max()) + 1
    if letters > max(LETTERS, 256):
        return _by_doubling(text)
    smaller = _smaller(text)
    left = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    buckets = _Buckets(text, smaller, letters)
    if len(left) > 1:
        is_left = np.zeros(n, bool)
        is_left[left] = True
        order = buckets.induce(left)
        order = order[is_left[order]]
        names = _named(text, left, order)
        if names.max() < len(left) - 1:
            left = left[suffix_array(names)]
        else:
            left = order
    return buckets.induce(left)


def _named(text: np.ndarray, left: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Names of the leftmost-smaller substrings, in order of text; equal ones share one."""
    n, number = len(text), np.empty(len(text), np.int64)
    number[left] = np.arange(len(left))
    length = np.append(np.diff(left) + 1, n - left[-1])
    size = length[number[order]]
    a, b = order[:-1], order[1:]
    same = size[1:] == size[:-1]
    live, k = np.flatnonzero(same), 0
    while len(live):
        live = live[k < size[live]]
        ok = text[a[live] + k] == text[b[live] + k]
        same[live[~ok]] = False
        live, k = live[ok], k + 1
    same &= (a + size[:-1] < n) | (a + size[:-1] == b + size[1:])
    names = np.empty(len(left), np.int64)
    names[number[order]] = np.concatenate([[0], np.cumsum(~same)])
    return names


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes up to ``most``: for each place of the text, how long a prefix
    its suffix shares with the suffix before it in order (all suffixes or some of them)."""
    n = len(text)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text.astype(np.uint8), np.zeros(most + 8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    eight = np.ascontiguousarray(eight).view("<u8").reshape(-1)
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(before >= 0)
    k = 0
    while len(live) and k < most:
        x = eight[live + k] ^ eight[before[live] + k]
        equal = x == 0
        lost = x[~equal]
        # bytes that agree before the first that differs
        out[live[~equal]] = k + (np.bitwise_count((lost & (~lost + np.uint64(1))) - np.uint64(1)) // 8)
        live, k = live[equal], k + 8
    out[live] = most
    return np.minimum(np.minimum(out, most), np.minimum(n - np.arange(n), np.where(before >= 0, n - before, 0)))
