"""64-bit keys of words and shingles, computed with numpy over the UTF-8 bytes of a text.

A word's key is a polynomial over its bytes, taken from one running sum over the
text, and then mixed; the same word has the same key in every process.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BLOCK = 4_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


_BYTES = constants(256, 11)
_STEP = 0x5851F42D4C957F2F
_BACK = pow(_STEP, -1, 1 << 64)
_ORDER = constants(64, 17) | U(1)
_powers = [np.ones(1, U), np.ones(1, U)]

#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the step and of its inverse."""
    if len(_powers[0]) <= n:
        for i, step in enumerate((_STEP, _BACK)):
            x = np.full(max(n + 1, 2 * len(_powers[i])), step, U)
            x[0] = 1
            _powers[i] = np.cumprod(x)
    return _powers[0], _powers[1]


def running(data: np.ndarray) -> np.ndarray:
    """Running sums; the key of bytes s to e before mixing is (sum[e] - sum[s]) * inverse power[s]."""
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTES[data] * powers(len(data))[0][: len(data)], out=sums[1:])
    return sums


def bounds(data: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, which are maximal runs without blanks."""
    edge = np.ones(len(data) + 2, np.int8)
    edge[1:-1] = blank[data]
    step = np.diff(edge)
    return np.flatnonzero(step < 0), np.flatnonzero(step > 0)


def word_keys(text: bytes, blank: np.ndarray = BLANKS) -> np.ndarray:
    """Keys of the words of a text, in order."""
    found, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > BLOCK:  # cut a very long text between words
            here = np.frombuffer(text, np.uint8, offset=at)
            cut = np.flatnonzero(blank[here[:BLOCK]])
            if not len(cut):
                cut = np.flatnonzero(blank[here])[:1]
            if len(cut):
                end = at + int(cut[-1]) + 1
        data = np.frombuffer(text, np.uint8, end - at, at)
        starts, ends = bounds(data, blank)
        sums = running(data)
        found.append(mix((sums[ends] - sums[starts]) * powers(len(data))[1][starts] + (ends - starts).astype(U)))
        at = end
    return np.concatenate(found) if found else np.zeros(0, U)


def joined(keys: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Keys of each n neighbours, in order."""
    total = np.full(len(keys) - n + 1, salt, U)
    for j in range(n):
        total += keys[j : len(keys) - n + 1 + j] * _ORDER[j % 64]
    return mix(total)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct keys of the n-word shingles; of the whole sequence where a text has fewer words."""
    if not text:
        return np.zeros(0, U)
    keys = word_keys(text.encode("utf-8", "surrogatepass").translate(LOWER))
    if not len(keys):
        return keys
    return np.unique(joined(keys, n) if len(keys) >= n else joined(keys, len(keys), len(keys)))
