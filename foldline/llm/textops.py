"""Vectorised word operations shared by the text operators of this subpackage.

A batch of texts is treated as one UTF-8 buffer. Words are maximal runs of bytes outside
``[\\x20\\x09-\\x0D]``; letters A-Z are lower-cased. Each word gets a 64-bit hash (a polynomial
over randomly mapped bytes, modulo 2**64, computed for all words of the buffer with one cumulative
sum), so no Python object is made per word. Equal words have equal hashes; two different words
share one with a probability of about 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)          # odd, so that powers are invertible modulo 2**64
_CHUNK = 1 << 20                       # bytes hashed at a time


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (xor-shift / multiply rounds)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _inverse(a: int, bits: int = 64) -> int:
    return pow(a, -1, 1 << bits)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_POW = np.ones(_CHUNK + 1, dtype=U)
_POW[1:] = _BASE
np.cumprod(_POW, out=_POW)
_INV = np.ones(_CHUNK + 1, dtype=U)
_INV[1:] = U(_inverse(int(_BASE)))
np.cumprod(_INV, out=_INV)


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word of ``buf`` (uint8)."""
    inside = np.empty(len(buf) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[buf], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the (lower-cased) byte ranges; ranges are ordered and do not overlap."""
    out = np.zeros(len(start), dtype=U)
    i, n = 0, len(start)
    while i < n:
        base = int(start[i])
        j = int(np.searchsorted(end, base + _CHUNK, side="right"))
        if j <= i:                                   # one word longer than a chunk
            h = U(0)
            for at in range(base, int(end[i]), _CHUNK):
                part = buf[at:min(at + _CHUNK, int(end[i]))]
                v = (_BYTE[part] * _POW[:len(part)]).sum(dtype=U)
                h = mix(np.array([h ^ v], dtype=U))[0]
            out[i] = h
            i += 1
            continue
        seg = buf[base:int(end[j - 1])]
        acc = np.zeros(len(seg) + 1, dtype=U)
        np.cumsum(_BYTE[seg] * _POW[:len(seg)], out=acc[1:])
        s, e = start[i:j] - base, end[i:j] - base
        out[i:j] = (acc[e] - acc[s]) * _INV[s]
        i = j
    return mix(out ^ (end - start).astype(U))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one space after each text, and the ``n + 1`` text offsets.
    A null text counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    parts = [b"" if v is None else v.encode("utf-8", "surrogatepass") for v in col.to_pylist()]
    lens = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
    off = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum(lens, out=off[1:])
    return np.frombuffer(b" ".join(parts) + b" " if parts else b"", dtype=np.uint8), off


def batch_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts of a column in order, and the ``n + 1`` word offsets of the texts."""
    buf, off = text_buffer(col)
    s, e = word_spans(buf)
    return hash_spans(buf, s, e), np.searchsorted(s, off)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k``-word shingles of one text, in order, repeats included. A text with fewer
    words has one shingle, its whole sequence; one without words has none."""
    n = len(words)
    if n == 0:
        return np.empty(0, dtype=U)
    width = min(n, k)
    acc = np.full(n - width + 1, U(width), dtype=U)
    for i in range(width):
        acc = mix(acc * U(0x9FB21C651E98DF25) + words[i:n - width + 1 + i])
    return acc


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text at most (one row at least), so
    working memory does not depend on how many long texts share a batch."""
    for b in batches:
        if b.num_rows == 0:
            continue
        size = np.cumsum([0 if v is None else v for v in pc.binary_length(b.column(text)).to_pylist()])
        i = 0
        while i < b.num_rows:
            done = size[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield b.slice(i, j - i)
            i = j
