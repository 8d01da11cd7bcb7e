"""Byte n-grams of many texts at once, in numpy: the features of both classifiers."""

from __future__ import annotations

import numpy as np

STEP = 1 << 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def hashed(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """For each place, a hash in [0, 2**bits) of the n bytes (n <= 8) that begin there; len(data) - n + 1 of them."""
    m = len(data) - n + 1
    if m <= 0:
        return np.empty(0, np.int64)
    key = data[:m].astype(np.uint64)
    for i in range(1, n):
        key = (key << np.uint64(8)) | data[i : m + i]
    key = (key + np.uint64(n * 0x51ED27)) * np.uint64(0x9E3779B97F4A7C15)
    return (key >> np.uint64(64 - bits)).astype(np.int64)


def counts(texts: list[bytes], sizes: tuple[int, ...], bits: int, lower: bool) -> np.ndarray:
    """texts x 2**bits: how often each hashed n-gram occurs. n-grams never cross texts."""
    out = np.zeros((len(texts), 1 << bits), np.float32)
    for row, text in zip(out, texts, strict=True):
        data = np.frombuffer(text, np.uint8)
        data = _LOWER[data] if lower else data
        for n in sizes:
            for at in range(0, max(1, len(data) - n + 1), STEP):  # bounded temporaries, whole text
                if len(f := hashed(data[at : at + STEP + n - 1], n, bits)):
                    row += np.bincount(f, minlength=1 << bits)
    return out


def present(text: bytes, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """The hashed n-grams that occur in a text, each once, ascending."""
    seen = np.zeros(1 << bits, np.bool_)
    data = np.frombuffer(text, np.uint8)
    for n in sizes:
        for at in range(0, max(1, len(data) - n + 1), STEP):
            seen[hashed(data[at : at + STEP + n - 1], n, bits)] = True
    return np.flatnonzero(seen)
