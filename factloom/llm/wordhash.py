"""Numpy kernels over the bytes of one Arrow batch of texts.

A word is a maximal run of ASCII letters, digits and bytes of non-ASCII
characters.  Nothing here is per character in Python; texts of any length are
handled in pieces of ``CHUNK_BYTES`` (a longer text is a piece of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20

_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = True
_WORD[ord("a") : ord("z") + 1] = True
_WORD[ord("A") : ord("Z") + 1] = True
_WORD[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class Texts(NamedTuple):
    """Texts laid end to end: text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Word hashes; text i has words[first[i]:first[i + 1]]."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray  # first byte and number of bytes of each word
    lengths: np.ndarray


def texts_of(array: pa.Array) -> Texts:
    """Bytes of a string array; NULL is the empty text."""
    array = pc.fill_null(array.cast(pa.large_string()), "")
    _, offsets, data = array.buffers()
    n = len(array)
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def pieces(array: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about ``limit`` bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += int(size) + 1
    if len(sizes):
        yield start, len(sizes)


def lowered(array: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(array, ""))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _BASE, np.uint64))


def run_hashes(data: np.ndarray, member: np.ndarray, offsets: np.ndarray) -> Words:
    """Hashes of the maximal runs of member bytes, never across two texts."""
    if not member.any():
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), *[np.zeros(0, np.int64)] * 2)
    begins = member.copy()
    begins[1:] &= ~member[:-1]
    inner = offsets[:-1][np.diff(offsets) > 0]
    begins[inner] = member[inner]
    starts = np.flatnonzero(begins)
    kept = np.flatnonzero(member)
    at = np.searchsorted(kept, starts)
    lengths = np.diff(np.append(at, len(kept)))
    places = np.arange(len(kept)) - np.repeat(at, lengths)
    powers = _powers(int(lengths.max()))
    with np.errstate(over="ignore"):
        h = np.add.reduceat(powers[places] * (data[kept].astype(np.uint64) + np.uint64(1)), at)
    return Words(mix(h), np.searchsorted(starts, offsets), starts, lengths)


def stems(texts: Texts, words: Words, sizes: tuple[int, ...]) -> np.ndarray:
    """Hashes of the first bytes of each word, sizes x words; 0 for a shorter word."""
    last = max(len(texts.data) - 1, 0)
    code = np.zeros(len(words.starts), np.uint64)
    out = np.zeros((len(sizes), len(code)), np.uint32)
    for k in range(max(sizes)):
        code |= texts.data[np.minimum(words.starts + k, last)].astype(np.uint64) << np.uint64(8 * k)
        if k + 1 in sizes:
            long = words.lengths > k
            out[sizes.index(k + 1)] = np.where(long, (mix(code + np.uint64(k)) >> np.uint64(32)) | np.uint64(1), 0)
    return out


def words(texts: Texts) -> Words:
    return run_hashes(texts.data, _WORD[texts.data], texts.offsets)


def hash_of(word: str) -> int:
    """The hash that ``words`` gives this word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(run_hashes(raw, np.ones(len(raw), bool), np.array([0, len(raw)])).hashes[0])


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] for every i, 0 for an empty range."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def owners(first: np.ndarray) -> np.ndarray:
    """For every word the number of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))
