"""Vectorised word hashing and shingling over Arrow text columns (numpy, no loop over words)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from layoutlint.llm.common import slices, utf8_views

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3 | 1
_MASK = (1 << 64) - 1
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) <= n:
        size = max(1 << 20, n) + 1
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"], _powers["down"]


def byte_table(is_word) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to words, and the bytes with A-Z lower-cased."""
    word = np.array([is_word(b) for b in range(256)], bool)
    lower = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
    return word, lower


#: Words are the runs between ASCII blanks.
BLANK_SEPARATED = byte_table(lambda b: b != 32 and not 9 <= b <= 13)


def word_hashes(data: np.ndarray, starts: np.ndarray, table) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each lower-cased word and where it begins; words end at the row boundaries ``starts``."""
    word, lower = table
    is_word = word[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    edge[n] = True
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = is_word
    begin = np.flatnonzero(is_word & (edge[:-1] | ~inside[:-2]))
    end = np.flatnonzero(is_word & (edge[1:] | ~inside[2:])) + 1
    up, down = _tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((lower[data] + np.uint64(1)) * up[:n], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin]), begin


def shingle_sets(column: pa.Array, k: int, table=BLANK_SEPARATED) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, the rows' sorted distinct shingle hashes in one array, and their counts.

    A row with fewer than ``k`` words, but at least one, has its whole word sequence as single shingle;
    a row without words has none.
    """
    data, offsets = utf8_views(column)
    for i, j in slices(offsets):
        at = offsets[i : j + 1] - offsets[i]
        part = data[offsets[i] : offsets[j]]
        hashes, begin = word_hashes(part, at, table) if len(part) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        first = np.searchsorted(begin, at)
        words = np.diff(first)
        n = max(0, len(hashes) - k + 1)
        grams = np.zeros(n, np.uint64)
        for q in range(k):
            grams *= _ODD
            grams += hashes[q : q + n]
        grams = mix(grams)
        sets, counts = [], np.zeros(j - i, np.int64)
        for r in np.flatnonzero(words):
            f, w = first[r], words[r]
            if w >= k:
                own = np.sort(grams[f : f + w - k + 1])
                if len(own) > 1:
                    keep = np.empty(len(own), bool)
                    keep[0] = True
                    np.not_equal(own[1:], own[:-1], out=keep[1:])
                    own = own[keep]
            else:
                own = np.full(1, w, np.uint64)
                for q in range(w):
                    own = own * _ODD + hashes[f + q]
                own = mix(own)
            counts[r] = len(own)
            sets.append(own)
        yield i, np.concatenate(sets) if sets else np.zeros(0, np.uint64), counts
