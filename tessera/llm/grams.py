"""Hashed n-grams, of bytes or characters, of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A fixed odd multiplier (the golden ratio in 64 bits); any would do.
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x moves every bit of the result."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def byte_grams(flat: np.ndarray, at: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """bucket of each n-gram of bytes that lies within one text, and the number of its text; n is 8 at most.

    buckets is a power of two. Texts shorter than n bytes have none.
    """
    if len(flat) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    key = np.full(len(flat) - n + 1, n, np.uint64)
    for i in range(n):
        key = (key << np.uint64(8)) | flat[i : len(flat) - n + 1 + i]
    return within_texts(((key * GOLDEN) >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64), at, n)


def within_texts(bucket: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the buckets of all n-grams of a flat run those of n-grams within one text, and the numbers of their texts."""
    size = np.diff(at)
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)[: len(bucket)]
    inside = np.ones(len(bucket), bool)
    for i in range(1, n):  # n-grams that would run past the end of a text
        ends = at[1:] - i
        inside[ends[(ends >= 0) & (ends < len(bucket)) & (size >= i)]] = False
    return bucket[inside], owner[inside]


def code_points(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, case folded, in one run, and the n + 1 places where texts begin; null is empty."""
    folded = [x.casefold() if x else "" for x in values.to_pylist()]
    at = np.zeros(len(folded) + 1, np.int64)
    np.cumsum([len(x) for x in folded], out=at[1:])
    return np.frombuffer("".join(folded).encode("utf-32-le", "surrogatepass"), np.uint32), at


def character_grams(flat: np.ndarray, at: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """bucket of each n-gram of code points that lies within one text, and the number of its text.

    buckets is a power of two. Texts shorter than n characters have none.
    """
    if len(flat) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    key = np.full(len(flat) - n + 1, n, np.uint64)
    for i in range(n):
        key = key * GOLDEN + flat[i : len(flat) - n + 1 + i]
    return within_texts((mixed(key) >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64), at, n)
