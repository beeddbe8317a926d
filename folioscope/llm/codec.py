"""Compact byte strings of integer arrays: byte planes, compressed, or a code for ascending ones."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

_HEAD = struct.Struct("<QB")
_SORTED = struct.Struct("<QQQB")


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers: as many byte planes as the largest needs."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    k = (int(values.max()).bit_length() + 7) // 8 if n else 0
    if not k:
        return _HEAD.pack(n, 0)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(n, 8)[:, :k].T)
    return _HEAD.pack(n, k) + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n, k = _HEAD.unpack_from(data)
    out = np.zeros((n, 8), dtype=np.uint8)
    if k:
        raw = pa.Codec("zstd").decompress(memoryview(data)[_HEAD.size :], decompressed_size=n * k)
        out[:, :k] = np.frombuffer(raw, dtype=np.uint8).reshape(k, n).T
    return out.reshape(-1).view(np.uint64)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending values: low bits as they are, the differences of the others in unary (Elias-Fano).

    That takes about half a bit for a value more than random values of their range need.
    """
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return _SORTED.pack(0, 0, 0, 0)
    base = int(values[0])
    v = values - values[0]
    low = max(0, (int(v[-1]) // n).bit_length() - 1)
    high = (v >> np.uint64(low)).astype(np.int64)
    marks = np.zeros(n + int(high[-1]), dtype=bool)
    marks[high + np.arange(n)] = True
    whole, rest = divmod(low, 8)
    octets = v.view(np.uint8).reshape(n, 8)
    bits = np.unpackbits(octets[:, whole, None], axis=1)[:, 8 - rest :] if rest else np.zeros(0, np.uint8)
    return _SORTED.pack(n, base, len(marks), low) + np.packbits(marks).tobytes() + np.ascontiguousarray(octets[:, :whole].T).tobytes() + np.packbits(bits).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    n, base, n_marks, low = _SORTED.unpack_from(data)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    raw = np.frombuffer(data, dtype=np.uint8, offset=_SORTED.size)
    at = -(-n_marks // 8)
    high = np.flatnonzero(np.unpackbits(raw[:at], count=n_marks)) - np.arange(n)
    whole, rest = divmod(low, 8)
    octets = np.zeros((n, 8), dtype=np.uint8)
    octets[:, :whole] = raw[at : at + whole * n].reshape(whole, n).T
    if rest:
        bits = np.zeros((n, 8), dtype=np.uint8)
        bits[:, 8 - rest :] = np.unpackbits(raw[at + whole * n :], count=n * rest).reshape(n, rest)
        octets[:, whole] = np.packbits(bits, axis=1)[:, 0]
    return octets.reshape(-1).view(np.uint64) + (high.astype(np.uint64) << np.uint64(low)) + np.uint64(base)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start[i], start[i] + 1, ... (size[i] of them) of all i in a row."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
