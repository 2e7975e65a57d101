"""Counting quotient filters over word-id n-grams: exact, compact, mergeable.

An n-gram of word ids below 2**bits packs into n * bits bits.  A Feistel network
permutes these numbers among themselves, so nothing is lost and equal n-grams meet
while neighbours scatter evenly.  A filter stores the permuted numbers in order:
the leading bits are the quotient, told by one `occupied` bit a slot and one `run
end` bit an entry; only the remaining bits are written out, in full.  Counters take
a byte, larger ones an overflow entry.  Filters merge as sorted lists.
"""

from __future__ import annotations

import struct

import numpy as np

from chronopanel.llm.spans import mixed

#: Fixed additions of the Feistel rounds.
ROUNDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
_HEAD = struct.Struct("<BBBBQQQ")


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def half_bits(bits: int, n: int) -> int:
    """Bits of either half of a packed n-gram; `bits` is even."""
    return bits * n // 2


def packed(ids: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of n-grams, given the columns of their word ids (below 2**bits, bits even)."""
    n, half = len(ids), np.uint64(bits // 2)
    u = [x.astype(np.uint64) for x in ids]
    b = np.uint64(bits)
    if n == 2:
        return u[0], u[1]
    if n == 3:
        return u[0] << half | u[1] >> half, (u[1] & _mask(bits // 2)) << b | u[2]
    return u[0] << b | u[1], u[2] << b | u[3]


def unpacked(hi: np.ndarray, lo: np.ndarray, bits: int, n: int) -> list[np.ndarray]:
    half, b, full = np.uint64(bits // 2), np.uint64(bits), _mask(bits)
    if n == 2:
        return [hi, lo]
    if n == 3:
        return [hi >> half, (hi & _mask(bits // 2)) << half | lo >> b, lo & full]
    return [hi >> b, hi & full, lo >> b, lo & full]


def permuted(hi: np.ndarray, lo: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of h bits after the Feistel rounds."""
    for c in ROUNDS:
        hi, lo = lo, hi ^ (mixed(lo + np.uint64(c)) & _mask(h))
    return hi, lo


def restored(hi: np.ndarray, lo: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    for c in reversed(ROUNDS):
        hi, lo = lo ^ (mixed(hi + np.uint64(c)) & _mask(h)), hi
    return hi, lo


def counted(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers in order, and the sums of their counts; sorted pieces are merged."""
    if not len(hi):
        return hi, lo, counts
    if 2 * h <= 64:
        key = hi << np.uint64(h) | lo
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
    else:
        order = np.lexsort((lo, hi))
        a, b = hi[order], lo[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    head = np.flatnonzero(new)
    return hi[order[head]], lo[order[head]], np.add.reduceat(counts[order], head)


def _planes(x: np.ndarray, bits: int) -> bytes:
    """The low bytes of numbers of so many bits, byte by byte."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)].T).tobytes()


def _numbers(data: memoryview, at: int, m: int, bits: int) -> tuple[np.ndarray, int]:
    width = -(-bits // 8)
    out = np.zeros((m, 8), np.uint8)
    if width:
        out[:, :width] = np.frombuffer(data, np.uint8, m * width, at).reshape(width, m).T
    return out.view("<u8").reshape(-1), at + m * width


def to_filter(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray, h: int, prefix_bits: int, prefix: int) -> bytes:
    """The filter of distinct ordered numbers that all begin with the same prefix."""
    m, free = len(hi), h - prefix_bits
    q = min(free, max(m.bit_length() - 1, 0))
    rest = np.uint64(free - q)
    tail = hi & _mask(free)
    quotient = (tail >> rest).astype(np.int64)
    last = np.append(quotient[1:] != quotient[:-1], True)
    occupied = np.zeros(1 << q, np.uint8)
    occupied[quotient] = 1
    large = np.flatnonzero(counts >= 255)
    parts = [
        _HEAD.pack(h, prefix_bits, q, 0, prefix, m, len(large)), np.packbits(occupied).tobytes(), np.packbits(last.astype(np.uint8)).tobytes(),
        _planes(tail & _mask(free - q), free - q), _planes(lo, h), np.minimum(counts, 255).astype(np.uint8).tobytes(),
        large.astype("<i8").tobytes(), counts[large].astype("<i8").tobytes(),
    ]
    return b"".join(parts)


def from_filter(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(halves, counts, h) of a filter's entries in order."""
    h, prefix_bits, q, _, prefix, m, many = _HEAD.unpack_from(data)
    at, view, free = _HEAD.size, memoryview(data), h - prefix_bits
    slots = -(-(1 << q) // 8)
    occupied = np.flatnonzero(np.unpackbits(np.frombuffer(view, np.uint8, slots, at), count=1 << q))
    at += slots
    last = np.flatnonzero(np.unpackbits(np.frombuffer(view, np.uint8, -(-m // 8), at), count=m))
    at += -(-m // 8)
    tail, at = _numbers(view, at, m, free - q)
    lo, at = _numbers(view, at, m, h)
    counts = np.frombuffer(view, np.uint8, m, at).astype(np.int64)
    at += m
    counts[np.frombuffer(view, "<i8", many, at)] = np.frombuffer(view, "<i8", many, at + 8 * many)
    quotient = np.repeat(occupied, np.diff(last, prepend=-1)).astype(np.uint64)
    return np.uint64(prefix << free) | quotient << np.uint64(free - q) | tail, lo, counts, h
