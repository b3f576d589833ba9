"""XXH64 of many byte spans at once, from its published description, on NumPy arrays."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
# The primes of the hash.
_P = [U64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << U64(bits)) | (x >> U64(64 - bits))


def _lane(x: np.ndarray) -> np.ndarray:
    return _turned(x * _P[1], 31) * _P[0]


def _unaligned(data: np.ndarray, kind: type) -> np.ndarray:
    """The number that begins at each byte."""
    width = np.dtype(kind).itemsize
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded[:width].view(kind), (len(data) + 1,), (1,))


def _stripes(eight: np.ndarray, starts: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """What the four lanes make of whole 32-byte stripes."""
    primes = [int(p) for p in _P]
    first = (seed + primes[0] + primes[1], seed + primes[1], seed, seed - primes[0])
    lanes = [np.full(len(starts), x & (2**64 - 1), U64) for x in first]
    live, at, left = np.arange(len(starts)), starts, size
    while len(live):
        for k, lane in enumerate(lanes):
            lane[live] = _turned(lane[live] + eight[at + 8 * k] * _P[1], 31) * _P[0]
        go = left >= 64
        live, at, left = live[go], at[go] + 32, left[go] - 32
    h = sum((_turned(lane, bits) for lane, bits in zip(lanes, (1, 7, 12, 18))), np.zeros(len(starts), U64))
    for lane in lanes:
        h = (h ^ _lane(lane)) * _P[0] + _P[3]
    return h


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """The hash of the bytes of each span."""
    size = ends - starts
    eight, four = _unaligned(data, U64), _unaligned(data, np.uint32)
    h, at = np.full(len(starts), U64(seed)) + _P[4], starts.copy()
    long = np.flatnonzero(size >= 32)
    if len(long):
        h[long] = _stripes(eight, starts[long], size[long], seed)
        at[long] += size[long] // 32 * 32
    h += size.astype(U64)

    def tail(width: int, step) -> bool:
        live = np.flatnonzero(ends - at >= width)
        if len(live):
            h[live] = step(h[live], at[live])
            at[live] += width
        return len(live) > 0

    while tail(8, lambda x, i: _turned(x ^ _lane(eight[i]), 27) * _P[0] + _P[3]):
        pass
    tail(4, lambda x, i: _turned(x ^ (four[i].astype(U64) * _P[0]), 23) * _P[1] + _P[2])
    while tail(1, lambda x, i: _turned(x ^ (data[i].astype(U64) * _P[4]), 11) * _P[0]):
        pass
    h = (h ^ (h >> U64(33))) * _P[1]
    h = (h ^ (h >> U64(29))) * _P[2]
    return h ^ (h >> U64(32))
