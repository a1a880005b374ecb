"""Vectorised words over many texts at once: positions, hashes and owners, by a table of byte classes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Lower-cases A-Z and leaves every other byte, so UTF-8 stays whole.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: ASCII letters and digits, and every byte of characters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of words: all but ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    data: np.ndarray  # bytes of all words, one after the other
    starts: np.ndarray  # where each word starts in data
    ends: np.ndarray
    hashes: np.ndarray  # 64-bit hash of each word's bytes
    docs: np.ndarray  # for each text, the index of its first word; one more at the end
    at: np.ndarray  # where each word starts in the texts joined by one byte


def split(texts: list[bytes], kind: np.ndarray, lower: bool = True) -> Words:
    """The words of each text: longest runs of bytes of ``kind``."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        raw = LOWER[raw]
    inside = kind[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate([[0], edge])
    first, last = edge[0::2], edge[1::2]  # a text ends in a line end, so every word ends
    sizes = last - first
    data = raw[inside]
    starts = np.cumsum(sizes) - sizes
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    docs = np.searchsorted(first, bounds)
    return Words(data, starts, starts + sizes, hash_words(data, starts, sizes), docs, first)


def hash_words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.arange(len(data)) - np.repeat(starts, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), _STEP, np.uint64))
    h = np.add.reduceat(_BYTE[data] * powers[at], starts)
    h ^= h >> np.uint64(29)
    return h * _STEP
