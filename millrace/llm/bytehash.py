"""Hashes of words and byte windows over many texts at once."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
#: A random number for each byte value, and an odd base with its inverse modulo 2**64.
TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, b in enumerate((BASE, INVERSE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the polynomial over ``data``, and the inverse powers that shift a part to 0."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * up[:-1], out=sums[1:])
    return sums, down


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the bounds of each text's words.

    Words are runs between ASCII white space, in lower case.
    """
    raw = [t.lower().encode("utf-8") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = IS_SPACE[data]
    edge = np.empty(len(data), bool)
    edge[0] = not space[0]
    np.logical_and(~space[1:], space[:-1], out=edge[1:])
    starts = np.flatnonzero(edge)
    edge[:-1] = space[1:] & ~space[:-1]
    edge[-1] = False
    ends = np.flatnonzero(edge) + 1
    sums, down = prefix(data)
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    at = np.cumsum([0] + [len(r) + 1 for r in raw])
    return hashes, np.searchsorted(starts, at)
