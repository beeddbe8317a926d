"""Arrow batches in pieces of bounded size, for functions that make Python objects of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose Python objects are held at once.
PIECE_BYTES = 1 << 20
#: Words of lists that are counted at once.
PIECE_WORDS = 1 << 18


def _cut(batches: Iterator[pa.RecordBatch], sizes: Callable[[pa.RecordBatch], pa.Array], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, in pieces whose sizes add up to `most` at most, or of one row."""
    for batch in batches:
        upto = np.cumsum(np.asarray(pc.fill_null(sizes(batch), 0), dtype=np.int64))
        a = 0
        while a < len(upto):
            z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, "right")))
            yield batch.slice(a, z - a)
            a = z


def pieces(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order; a piece holds at most `PIECE_BYTES` of column `text`, or one row."""
    return _cut(batches, lambda b: pc.binary_length(b.column(text)), PIECE_BYTES)


def word_pieces(batches: Iterator[pa.RecordBatch], lists: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order; a piece holds at most `PIECE_WORDS` items of the lists of a column, or one row."""
    return _cut(batches, lambda b: pc.list_value_length(b.column(lists)), PIECE_WORDS)


def changes(keys: pa.Array) -> np.ndarray:
    """Of each row whether its key is another than the one before; the first counts as the same.  Null equals null."""
    if pa.types.is_struct(keys.type):
        return np.logical_or.reduce([changes(c) for c in [keys.is_null(), *keys.flatten()]])
    codes = np.asarray(pc.dictionary_encode(keys, null_encoding="encode").indices)
    return np.concatenate([[False], codes[1:] != codes[:-1]])[: len(keys)]
