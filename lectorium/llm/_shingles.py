"""Sets of word shingles as sorted 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240817)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes hashed at once. Longer texts make a longer stretch of their own.
STRETCH = 1 << 19
#: Powers are kept up to so many, in one table that shorter stretches use the beginning of.
MOST_POWERS = 1 << 20

_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    if _POWERS and len(_POWERS[0][0]) >= n:
        return _POWERS[0]
    size, out = 1 << max(16, (n - 1).bit_length()), []
    for base in (_BASE, _INVERSE):
        p = np.ones(1, np.uint64)
        while len(p) < size:
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
        out.append(p)
    if size <= MOST_POWERS:
        _POWERS[:] = [tuple(out)]
    return tuple(out)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _stretch(texts: list[np.ndarray], n: int) -> list[np.ndarray]:
    space = np.asarray([32], np.uint8)
    b = np.concatenate([x for t in texts for x in (t, space)])
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8), append=-1 if inside[-1] else 0))
    starts, stops = edge[0::2], edge[1::2]
    power, inverse = _powers(len(b))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWER[b]] * power[: len(b)])])
        word = mix((total[stops] - total[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
        first = np.searchsorted(starts, np.concatenate([[0], ends[:-1]]))
        last = np.concatenate([first[1:], [len(starts)]])
        rolled = np.zeros(max(0, len(word) - n + 1), np.uint64)
        for k in range(n):
            rolled += word[k : len(word) - n + 1 + k] * _PLACE[k]
        rolled = mix(rolled, 1)
        out = []
        for a, z in zip(first, last, strict=True):
            if z - a >= n:
                out.append(np.unique(rolled[a : z - n + 1]))
            elif z > a:
                out.append(mix(np.asarray([np.sum(word[a:z] * _PLACE[: z - a]) + np.uint64(z - a)], np.uint64), 2))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[np.ndarray], n: int) -> list[np.ndarray]:
    """For each text (UTF-8 bytes) the sorted distinct hashes of its n-word shingles; of a text with fewer
    words, but not none, the hash of the whole sequence."""
    out, held, size = [], [], 0
    for t in texts:
        if held and size + len(t) > STRETCH:
            out += _stretch(held, n)
            held, size = [], 0
        held.append(t)
        size += len(t)
    return out + (_stretch(held, n) if held else [])


def texts_of(column) -> list[np.ndarray]:
    """The bytes of an Arrow string column; null is empty."""
    return [np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid and len(x.as_buffer()) else np.zeros(0, np.uint8) for x in column]


def summed(values: np.ndarray, seed: int) -> int:
    """A signed 64-bit hash of a set of hashes and its size."""
    with np.errstate(over="ignore"):
        return int(mix(np.asarray([np.sum(mix(values, seed)) + np.uint64(len(values))], np.uint64), seed + 1).view(np.int64)[0])
