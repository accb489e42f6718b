"""Golomb codes of sorted numbers and bit maps, in numpy.

A sorted list of distinct numbers is stored as its gaps. With the parameter ``2**k`` near the mean gap, a gap is a
quotient in unary and a remainder of k bits; all quotients come first, then all remainders, so that both planes
are read without a loop per number. The cost is about k + 1.5 bits per number.
"""

from __future__ import annotations

import numpy as np

HEAD = 9          # bytes before the planes: count (8) and k (1)


def encode(values: np.ndarray) -> bytes:
    """The code of ``values``: distinct, ascending, below 2**63, the first one counted from -1."""
    n = len(values)
    if not n:
        return bytes(HEAD)
    gap = np.diff(values.astype(np.int64), prepend=-1) - 1
    mean = int(gap.sum()) // n
    k = max(0, mean.bit_length() - 1)
    quotient = gap >> k
    ones = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(ones[-1]) + 1, dtype=np.uint8)
    unary[ones] = 1
    rest = (gap & ((1 << k) - 1)).astype(">u8").view(np.uint8).reshape(n, 8)
    bits = np.unpackbits(rest, axis=1)[:, 64 - k:]
    return n.to_bytes(8, "little") + bytes([k]) + np.packbits(unary).tobytes() + np.packbits(bits).tobytes()


def decode(code: bytes) -> np.ndarray:
    n, k = int.from_bytes(code[:8], "little"), code[8]
    if not n:
        return np.zeros(0, dtype=np.int64)
    plane = np.frombuffer(code, dtype=np.uint8, offset=HEAD)
    size = (n * k + 7) // 8
    ones = np.flatnonzero(np.unpackbits(plane[:len(plane) - size]))[:n]
    gap = (np.diff(ones, prepend=-1) - 1) << k
    if k:
        bits = np.unpackbits(plane[len(plane) - size:])[:n * k].reshape(n, k)
        wide = np.zeros((n, 64), dtype=np.uint8)
        wide[:, 64 - k:] = bits
        gap += np.packbits(wide, axis=1).view(">u8").ravel().astype(np.int64)
    return np.cumsum(gap + 1) - 1


def words_of(bits: np.ndarray) -> np.ndarray:
    """A bit map as 64-bit words, bit i in word i // 64 at i % 64."""
    packed = np.packbits(bits.astype(np.uint8), bitorder="little")
    return np.concatenate([packed, np.zeros(-len(packed) % 8, dtype=np.uint8)]).view("<i8")
