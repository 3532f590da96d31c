"""Hashed byte-gram vectors of whole texts, and linear models on them."""

from __future__ import annotations

import numpy as np

#: Bytes that count as letters: ASCII letters in lower case, and all of multi-byte characters.
_LETTERS = np.full(256, 32, np.uint8)
for _b in range(256):
    if 97 <= _b <= 122 or _b >= 128:
        _LETTERS[_b] = _b
    elif 65 <= _b <= 90:
        _LETTERS[_b] = _b + 32
_STEP = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def gram_vectors(texts: list[str], size: int, orders: tuple[int, ...], letters_only: bool) -> np.ndarray:
    """(texts, size) hashed counts of byte grams, square-rooted and of unit length.

    With ``letters_only`` everything but letters becomes one space between words. A text
    without grams has a zero vector. Whole texts, any length: memory goes with the number of
    texts, and with the bytes at hand.
    """
    raw = [f" {t.lower() if letters_only else t} ".encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    doc = np.repeat(np.arange(len(raw), dtype=np.int32), [len(r) for r in raw])
    if letters_only:
        data = _LETTERS[data]
        blank = data == 32
        keep = np.ones(len(data), bool)
        keep[1:] = ~(blank[1:] & blank[:-1]) | (doc[1:] != doc[:-1])
        data, doc = data[keep], doc[keep]
    out = np.zeros(len(raw) * size, np.float64)
    wide = data.astype(np.uint32)
    for k in orders:
        n = len(wide) - k + 1
        if n <= 0:
            continue
        h = np.full(n, k * 0x1B873593 & 0xFFFFFFFF, np.uint32)
        for j in range(k):
            h = (h ^ wide[j : j + n]) * _STEP[j]
            h ^= h >> np.uint32(15)
        inside = doc[:n] == doc[k - 1 :]
        at = doc[:n][inside].astype(np.int64) * size + (h[inside] % np.uint32(size))
        out += np.bincount(at, minlength=len(out))
    x = np.sqrt(out).reshape(len(raw), size).astype(np.float32)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _scale(x: np.ndarray) -> float:
    """The largest eigenvalue of x'x, by power iteration."""
    v = np.ones(x.shape[1], np.float32)
    for _ in range(12):
        v = x.T @ (x @ v)
        v /= max(1e-12, np.linalg.norm(v))
    return float(np.linalg.norm(x @ v) ** 2)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, rounds: int = 120) -> np.ndarray:
    """Linear support vector machine (squared hinge), y in {-1, 1}; the last weight is the bias.

    Classes count alike, whatever their sizes; accelerated gradient steps.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * len(y) * c
    rate = 1 / (1 + 2 * float(weight.max()) * _scale(x))
    w = np.zeros(x.shape[1], np.float32)
    at, t = w, 1.0
    for _ in range(rounds):
        miss = np.maximum(0, 1 - y * (x @ at))
        new = at - rate * (at - 2 * x.T @ (weight * y * miss))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        at, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def fit_logistic(x: np.ndarray, p: np.ndarray, c: float = 30.0, rounds: int = 250) -> np.ndarray:
    """Logistic regression on soft labels p in [0, 1]; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    # both labels count alike
    weight = c * (p / max(1e-9, p.mean()) + (1 - p) / max(1e-9, (1 - p).mean())).astype(np.float32) / 2
    weight = np.minimum(weight, 20 * c)
    rate = 1 / (1 + 0.25 * float(weight.max()) * _scale(x))
    w = np.zeros(x.shape[1], np.float32)
    at, t = w, 1.0
    for _ in range(rounds):
        y = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        new = at - rate * (at + x.T @ (weight * (y - p)).astype(np.float32))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        at, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def margins(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]
