"""Many slices of one buffer of bytes at once: their hashes, whether they are equal, and their bytes one after the other.

A buffer ends with ``PAD`` bytes that no slice holds, since slices are read eight bytes at a time.
"""

from __future__ import annotations

import numpy as np
import xxhash

PAD = 8
#: Slices from this length on are hashed one by one: the hash has another form there.
LONG = 32
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _windows(data: np.ndarray, kind: str) -> np.ndarray:
    """The numbers that begin at each byte."""
    return np.ndarray(len(data) - PAD + 1, kind, data, strides=(1,))


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    high = x >> np.uint64(64 - bits)
    x <<= np.uint64(bits)
    x |= high
    return x


def xxh64(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """The 64-bit xxHash of each slice, as ``xxhash.xxh64_intdigest`` and Spark's ``xxhash64`` have it."""
    eights, fours = _windows(data, "<u8"), _windows(data, "<u4")
    found = np.empty(len(starts), np.uint64)
    short = np.minimum(lengths, LONG).astype(np.uint8)
    order = np.argsort(short, kind="stable")
    ends = np.cumsum(np.bincount(short, minlength=LONG + 1))
    for length in np.flatnonzero(np.diff(ends[:LONG], prepend=0)):
        own = order[ends[length - 1] if length else 0 : ends[length]]
        at = starts[own]
        h = np.full(len(own), np.uint64(seed) + _P5 + np.uint64(length))
        left = int(length)
        while left >= 8:
            k = eights[at] * _P2
            k = _rotated(k, 31)
            k *= _P1
            h ^= k
            h = _rotated(h, 27)
            h *= _P1
            h += _P4
            at, left = at + 8, left - 8
        if left >= 4:
            h ^= fours[at] * _P1
            h = _rotated(h, 23)
            h *= _P2
            h += _P3
            at, left = at + 4, left - 4
        for _ in range(left):
            h ^= data[at] * _P5
            h = _rotated(h, 11)
            h *= _P1
            at = at + 1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
        found[own] = h
    long = order[ends[LONG - 1] :]
    if len(long):
        held = memoryview(data)
        found[long] = [xxhash.xxh64_intdigest(held[a : a + n], seed) for a, n in zip(starts[long].tolist(), lengths[long].tolist())]
    return found


def equal(data: np.ndarray, starts: np.ndarray, others: np.ndarray, lengths: np.ndarray) -> bool:
    """Whether each slice has the bytes of the other one of the same length."""
    eights = _windows(data, "<u8")
    while len(starts):
        cut = np.uint64(8) * (np.uint64(8) - np.minimum(lengths, 8).astype(np.uint64))
        if ((eights[starts] ^ eights[others]) << cut).any():
            return False
        more = lengths > 8
        starts, others, lengths = starts[more] + 8, others[more] + 8, lengths[more] - 8
    return True


def joined(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of all slices, one after the other."""
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(len(at))
    return data[at]
