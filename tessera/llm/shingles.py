"""Hashed words and word shingles of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tessera.llm.common import chunks, flat_bytes
from tessera.llm.grams import GOLDEN, LOWER, mixed

#: A value of 64 bits for each byte, and the odd multipliers of places in a word and of words in a shingle.
_RNG = np.random.default_rng(20240311)
BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = _RNG.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SALT = np.arange(65, dtype=np.uint64) * GOLDEN
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(flat: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, the n + 1 places where texts begin among them, and the byte where each begins.

    Words are runs of anything but space and bytes 9 to 13; lower folds A-Z.
    """
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), np.zeros(0, np.int64)
    solid = ~SPACE[flat]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    heads = at[:-1][np.diff(at) > 0]
    begins[heads] = solid[heads]
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), start
    within = np.arange(len(flat)) - start[np.maximum(np.cumsum(begins) - 1, 0)]
    within[~solid] = 0
    power = np.full(int(within.max()) + 1, STEP, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    value = BYTE[LOWER[flat] if lower else flat] * power[np.maximum(within, 0)]
    value[~solid] = 0
    return mixed(np.add.reduceat(value, start)), np.searchsorted(start, at), start


def shingles(word: np.ndarray, first: np.ndarray, n: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct n-word shingles; of all its words, if it has fewer than n."""
    out = []
    run = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for j in range(n):
        run += word[j : j + len(run)] * PLACE[j]
    run = mixed(run + SALT[n])
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(run[a : b - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(mixed(np.array([(word[a:b] * PLACE[: b - a]).sum(dtype=np.uint64)]) + SALT[b - a]))
        else:
            out.append(run[:0])
    return out


def shingle_sets(batch: pa.RecordBatch, n: int, limit: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of a batch with a text column, and the shingle sets of their rows."""
    for part in chunks(batch, "text", limit):
        word, first, _ = words(*flat_bytes(part.column("text")))
        yield part, shingles(word, first, n)


def signature(tokens: np.ndarray) -> int:
    """A 64-bit signature of a set, as a signed number."""
    total = np.array([np.add.reduce(mixed(tokens ^ GOLDEN))])
    return int(mixed(total + np.array([len(tokens)], np.uint64) * PLACE[0])[0].astype(np.int64))
