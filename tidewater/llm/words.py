"""Words of whole batches of texts, hashed with numpy over the UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D. A word's hash mixes its bytes eight at a time; the hash of a
run of words is a polynomial modulo the prime 2^61 - 1, whose value over any range comes from prefix sums, so that
hashes of k words cost the same for every k. Hashes find candidates; who needs certainty compares the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
PRIME, BASE = (1 << 61) - 1, 0x0F3C_71D9_5A4E_8B67 % ((1 << 61) - 1)
LONG = 128  # bytes from which a word is hashed by itself
_ODD, _SEED = U(0x9E3779B97F4A7C15), U(0xA0761D6478BD642F)
_powers: list[np.ndarray] = []


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x >> U(61)) + (x & U(PRIME))
    return np.where(x >= U(PRIME), x - U(PRIME), x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, for numbers below 2**61, by halves that fit in 64 bits."""
    low = U((1 << 31) - 1)
    a1, a0, b1, b0 = a >> U(31), a & low, b >> U(31), b & low
    mid = a1 * b0 + a0 * b1
    return _reduce(((a1 * b1) << U(1)) + (mid >> U(30)) + ((mid & U((1 << 30) - 1)) << U(31)) + a0 * b0)


def powers(n: int) -> list[np.ndarray]:
    """BASE**i and its inverse modulo the prime, for i below n at least."""
    global _powers
    if not _powers or len(_powers[0]) < n:
        out = []
        for x in (BASE, pow(BASE, -1, PRIME)):
            p = np.ones(1, U)
            while len(p) < max(n, 1 << 12):
                p = np.concatenate([p, times(p, np.full(len(p), U(pow(x, len(p), PRIME))))])
            out.append(p)
        _powers = out
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection whose output bits all depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the words at start to end; data goes on for 8 bytes behind the last word."""
    eight = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
    size = end - start
    h = np.full(len(start), _SEED)
    todo, at = np.flatnonzero(size <= LONG), 0
    while len(todo):
        left = size[todo] - at
        part = eight[start[todo] + at] & (~U(0) >> (U(64) - np.minimum(left, 8).astype(U) * U(8)))
        h[todo] = mix(h[todo] * _ODD + part)
        at += 8
        todo = todo[left > 8]
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    return mix(h ^ (size.astype(U) * _ODD))


class Words:
    """Words of several texts: start and end byte, number of the text, hash; first[t] is text t's first word."""

    def __init__(self, texts: list[bytes]):
        data = b" ".join(texts) + b" " * 9
        self.buf = np.frombuffer(data, np.uint8)[:-8]
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.at = np.concatenate([[0], np.cumsum(sizes)])
        inside = ~((self.buf == 32) | ((self.buf >= 9) & (self.buf <= 13)))
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0)))
        self.start, self.end = edge[::2], edge[1::2]
        self.text = np.searchsorted(self.at, self.start, "right") - 1
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.hash = word_hashes(data, self.start, self.end)
        # sums of hash * BASE**i: the halves of the terms are summed apart, as each sum fits in 64 bits
        terms = times(_reduce(self.hash), powers(len(self.hash) + 1)[0][: len(self.hash)])
        low, high = np.cumsum(terms & U((1 << 31) - 1), dtype=U), np.cumsum(terms >> U(31), dtype=U)
        total = _reduce(times(_reduce(high), np.full(len(high), U(1 << 31))) + _reduce(low))
        self.total = np.concatenate([np.zeros(1, U), total])

    def span(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of words start to stop (exclusive)."""
        down = powers(len(self.hash) + 1)[1]
        value = times(_reduce(self.total[stop] + U(PRIME) - self.total[start]), down[start])
        return mix(value + (stop - start).astype(U) * _ODD)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch in pieces of about `limit` bytes of text (one text at least), with the texts as UTF-8; null: empty."""
    for batch in batches:
        column = batch.column(text)
        at, size = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
            size += n
            if size >= limit or i + 1 == len(column):
                texts = column.slice(at, i + 1 - at).cast(pa.large_binary()).to_pylist()
                yield batch.slice(at, i + 1 - at), [t or b"" for t in texts]
                at, size = i + 1, 0
