"""Vectorised word splitting and 64-bit hashing of whole texts.

Words are runs of "word bytes" of the UTF-8 text.  Both word rules used by the operators
(white-space separated, and letters/digits/non-ASCII) only test ASCII code points, so a byte
table decides them exactly, and numpy does the work for a whole Arrow batch at once.

Hashes are polynomial hashes of the bytes with random 64-bit byte values, finished with an
avalanche mix.  They are equal on every executor and in every run.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U64 = np.uint64
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):
    _LIBC = None
#: Bytes that are hashed at once; bounds the working arrays to some tens of MB.
SEGMENT = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = int(_rng.integers(1, 2**62, dtype=np.uint64)) * 4 + 3
_MUL = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
_POWERS: dict[str, np.ndarray] = {}


def _class(chars: str | None = None, separators: bytes | None = None) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: `[^\x20\x09-\x0D]+`
SPACED = _class(separators=bytes([0x20, *range(0x09, 0x0E)]))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased
LETTERS = _class(separators=bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values, in place where possible."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = max(n, SEGMENT + 4096)
        p, q = np.full(size, U64(_BASE % 2**64)), np.full(size, U64(pow(_BASE, -1, 2**64)))
        p[0] = q[0] = 1
        with np.errstate(over="ignore"):
            _POWERS["p"], _POWERS["q"] = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _POWERS["p"], _POWERS["q"]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


@dataclass
class Words:
    """Words of a batch: byte span, row and hash of each, and where each row's words begin."""

    data: np.ndarray  # lower-cased bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # rows + 1 positions in the arrays above

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def _hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for spans in order; works through bounded segments."""
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + SEGMENT, side="right")))
            lo, hi = int(start[i]), int(end[j - 1])
            p, q = _powers(hi - lo + 1)
            sums = np.empty(hi - lo + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum(_BYTE[data[lo:hi]] * p[: hi - lo], out=sums[1:])
            s, e = start[i:j] - lo, end[i:j] - lo
            out[i:j] = mix((sums[e] - sums[s]) * q[s] + (e - s).astype(np.uint64))
            i = j
    return out


def split_words(column: pa.Array, word_bytes: np.ndarray) -> Words:
    """All words of a string column, lower-cased in A-Z."""
    raw, offsets = text_buffer(column)
    data = _LOWER[raw]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = word_bytes[data]
    change = inside[1:] != inside[:-1]
    # a row's end also ends a word
    joints = offsets[1:-1]
    joints = joints[(joints > 0) & (joints < len(data))]
    joints = np.unique(joints[inside[joints] & inside[joints + 1]]) if len(joints) else joints
    edges = np.flatnonzero(change)
    start, end = edges[::2], edges[1::2]
    if len(joints):
        start, end = np.sort(np.concatenate([start, joints])), np.sort(np.concatenate([end, joints]))
    first = np.searchsorted(start, offsets, side="left")
    return Words(data, start, end, _hash_spans(data, start, end), first)


def shingles(h: np.ndarray, first: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles, and where each row's begin.

    h: word hashes; first: where each row's words begin.  With `short`, a row with fewer words
    (but any) has its whole sequence as its one shingle.
    """
    count = np.diff(first)
    full = np.maximum(count - n + 1, 0)
    out_count = np.where((count > 0) & (full == 0), 1, full) if short else full
    out_first = np.concatenate([[0], np.cumsum(out_count)])
    out = np.empty(out_first[-1], dtype=np.uint64)
    with np.errstate(over="ignore"):
        if len(h) >= n:
            acc = h[: len(h) - n + 1] * _MUL[0]
            for k in range(1, n):
                acc = acc + h[k : len(h) - n + 1 + k] * _MUL[k]
            acc = mix(acc + U64(n))
        else:
            acc = np.zeros(0, np.uint64)
        long = full > 0
        if len(acc):
            keep = np.zeros(len(acc), dtype=bool)
            valid = np.zeros(len(acc) + 1, dtype=np.int32)
            np.add.at(valid, first[:-1][long], 1)
            np.add.at(valid, (first[:-1] + full)[long], -1)
            keep = np.cumsum(valid)[:-1] > 0
            place = np.zeros(out_first[-1], dtype=bool)
            mark = np.zeros(out_first[-1] + 1, dtype=np.int32)
            np.add.at(mark, out_first[:-1][long], 1)
            np.add.at(mark, out_first[1:][long], -1)
            place = np.cumsum(mark)[:-1] > 0
            out[place] = acc[keep]
        for r in np.flatnonzero((count > 0) & (full == 0)) if short else ():
            hs = h[first[r] : first[r + 1]]
            out[out_first[r]] = mix((hs * _MUL[: len(hs)]).sum(keepdims=True) + U64(len(hs)))[0]
    return out, out_first


def tidy() -> None:
    """Gives memory that a task no longer uses back to the machine: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `limit` bytes of text or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        total = np.cumsum(np.asarray(sizes, dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(total, done + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
    tidy()
