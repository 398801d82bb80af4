"""Flat word arrays of a batch of texts, for the operators that hash runs of words.

A batch of texts becomes one numpy array of 64-bit word hashes with the bounds of each text, so that
n-gram hashes, windows and set operations run over the whole batch at once.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_MAX_CACHE = 400_000
_cache: dict[str, int] = {}


def lower_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def plain_words(text: str) -> list[str]:
    """Lower case, canonically decomposed, combining marks dropped."""
    text = text.lower()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return WORD.findall(text)


def hashes(words: list[str]) -> list[int]:
    if len(_cache) > _MAX_CACHE:
        _cache.clear()
    out = []
    for w in words:
        h = _cache.get(w)
        if h is None:
            h = _cache[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return out


def flat(texts: list[str | None], split) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row, and the n+1 bounds of the texts."""
    flatten: list[int] = []
    bounds = [0]
    for t in texts:
        if t:
            flatten += hashes(split(t))
        bounds.append(len(flatten))
    return np.array(flatten, dtype=np.uint64), np.array(bounds, dtype=np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def grams(flatten: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k words and the index of its text; runs over a text's end are left out."""
    n = len(flatten) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x100000001B3) + mix(flatten[j : j + n] + np.uint64(j + 1))
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    same = owner[:n] == owner[k - 1 :]
    return mix(h[same]), owner[:n][same]
