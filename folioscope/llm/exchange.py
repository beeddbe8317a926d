"""Counting 64-bit items of a whole corpus, and answering each text chunk with its items' totals.

A corpus of words has nearly as many n-grams as words.  One row for each would move some twenty
bytes through every shuffle.  Here the corpus is held as chunks (some MB of text: row keys and
word hashes as a local vocabulary and packed positions).  A chunk asks each hash shard for the
totals of its own distinct items with one packed, sorted byte string; the shard adds up all
chunks' counts (this is the count table of that hash partition, joined to what the chunks hold)
and answers in the chunk's order.  Items are counted before the shuffle, so an item that is in
every text costs one entry per chunk, and shards are even by construction.  Chunks are dealt out
by their number when they are stored, so they don't move again to meet their answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import cut, cut_by
from .codec import pack, pack_sorted, unpack, unpack_sorted
from .words import pieces, split_words, tidy

#: Text bytes of a chunk; bounds the working memory of every later step.
CHUNK_BYTES = 4 << 20
#: Items of a shard, about.
SHARD_ITEMS = 2_000_000
#: Bits beyond log2 of the corpus's items by which repeats are looked for: one single item in 2^4 at most is taken for a repeat at first.
SPARE_BITS = 4

#: Makes from (word hashes, where each row's begin) the items of a chunk: any order, repeats count.
Items = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _pack_words(vocab: np.ndarray, often: np.ndarray) -> bytes:
    """Words in falling order of how often they occur, ascending among equals: those that occur once or twice are most."""
    at = np.searchsorted(-often, [-2, -1])
    parts = [pack(vocab[: at[0]]), pack_sorted(vocab[at[0] : at[1]]), pack_sorted(vocab[at[1] :])]
    return b"".join([len(p).to_bytes(8, "little") + p for p in parts])


def _unpack_words(data: bytes) -> np.ndarray:
    out, at = [], 0
    for read in (unpack, unpack_sorted, unpack_sorted):
        size = int.from_bytes(data[at : at + 8], "little")
        out.append(read(data[at + 8 : at + 8 + size]))
        at += 8 + size
    return np.concatenate(out)


class Chunk:
    """A decoded chunk row: keys (Arrow), first row number, word hashes and where rows begin."""

    def __init__(self, table: pa.Table | pa.RecordBatch, i: int = 0) -> None:
        col = lambda name: table.column(table.schema.get_field_index(name))[i]
        self.id, self.row = col("chunk").as_py(), col("row").as_py()
        self.keys = col("keys").values
        self.first = np.concatenate([[0], np.cumsum(unpack(col("counts").as_py()).astype(np.int64))])
        self.hash = _unpack_words(col("vocab").as_py())[unpack(col("ids").as_py()).astype(np.int64)]


def chunked(docs: DataFrame, key: str, text: str, word_bytes: np.ndarray, limit: int = CHUNK_BYTES) -> DataFrame:
    """The corpus as stored chunks: chunk, row, keys, counts, vocab, ids, n_words.

    Rows keep their place in a chunk, so that later passes agree on it even if an executor is
    lost and the input comes in another order.  A null text has no words; null and repeated keys
    are kept.
    """
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = source.schema["k"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, seq = TaskContext.get().partitionId(), 0, 0
        keys, counts, hashes, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, counts, hashes, size, rows, seq
            k, n = pa.concat_arrays(keys), np.concatenate(counts)
            vocab, ids, often = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")  # frequent words get small numbers, which pack well
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            vocab, ids = vocab[order], rank[ids]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + seq], pa.int64()),
                    pa.array([(part << 40) + rows], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(k)], pa.int32()), k),
                    *(pa.array([x], pa.binary()) for x in (pack(n), _pack_words(vocab, often[order]), pack(ids))),
                    pa.array([int(n.sum())], pa.int64()),
                ],
                names=["chunk", "row", "keys", "counts", "vocab", "ids", "n_words"],
            )
            rows, seq = rows + len(k), seq + 1
            keys, counts, hashes, size = [], [], [], 0
            return out

        for piece in pieces(batches, "t", limit // 4):
            w = split_words(piece.column(1), word_bytes)
            keys.append(piece.column(0))
            counts.append(np.diff(w.first))
            hashes.append(w.hash)
            size += len(w.data) + 16 * piece.num_rows
            if size >= limit:
                yield flush()
        if keys:
            yield flush()

    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("row", T.LongType()),
            T.StructField("keys", T.ArrayType(kind)),
            *(T.StructField(x, T.BinaryType()) for x in ("counts", "vocab", "ids")),
            T.StructField("n_words", T.LongType()),
        ]
    )
    return cut_by(source.mapInArrow(run, schema), "chunk")


def _bits(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(8, "little") + np.packbits(flags).tobytes()


def _flags(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8, offset=8), count=int.from_bytes(data[:8], "little")).astype(bool)


def _by_shard(values: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shards that hold some of the ascending values, and where every shard's begin."""
    at = np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])
    return np.flatnonzero(np.diff(at)), at


def _summed(table: pa.Table, counts: np.ndarray, packed: Callable[[np.ndarray], bytes], name: str) -> pa.Table:
    """The totals of a shard's items, in the order in which each chunk asked for them."""
    values = [unpack_sorted(x.as_py()) for x in table.column("values")]
    place = np.unique(np.concatenate(values), return_inverse=True)[1]
    total = np.bincount(place, weights=counts)[place]
    at = np.concatenate([[0], np.cumsum([len(x) for x in values])])
    out = [packed(total[at[i] : at[i + 1]]) for i in range(len(values))]
    tidy()
    return pa.table([table.column("chunk"), table.column("shard"), pa.array(out, pa.binary())], names=["chunk", "shard", name])


def totals(chunks: DataFrame, items: Items, n_words: int, per_word: float = 1.0) -> DataFrame:
    """chunk, shard, flags, totals: what `per_chunk` needs to tell each chunk its items' corpus totals.

    Most items of a corpus occur once.  So chunks first send only the leading bits of their items,
    some more than it takes to tell as many items apart: those whose bits occur once in the corpus
    have a total of 1 (flag 0).  Only the others are sent whole, with their counts, and added up.
    """
    n_items = max(2, ceil(n_words * per_word))
    shards = max(32, ceil(n_items / SHARD_ITEMS))
    edges = np.array([(i << 64) // shards for i in range(1, shards)], dtype=np.uint64)
    drop = np.uint64(64 - min(63, max(24, ceil(log2(n_items)) + SPARE_BITS)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = Chunk(batch, i)
                values, counts = np.unique(items(chunk.hash, chunk.first), return_counts=True)
                full, at = _by_shard(values, edges)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(full), chunk.id)),
                        pa.array(full.astype(np.int32)),
                        pa.array([pack_sorted(values[at[s] : at[s + 1]] >> drop) for s in full], pa.binary()),
                        pa.array([_bits(counts[at[s] : at[s + 1]] > 1) for s in full], pa.binary()),
                    ],
                    names=["chunk", "shard", "values", "counts"],
                )
        tidy()

    def repeats(table: pa.Table) -> pa.Table:
        counts = 1 + np.concatenate([_flags(x.as_py()) for x in table.column("counts")])
        return _summed(table, counts, lambda total: _bits(total > 1), "flags")

    def ask_whole(chunk: Chunk, flags: pa.Table) -> pa.Table:
        values, counts = np.unique(items(chunk.hash, chunk.first), return_counts=True)
        often = _repeated(flags, len(values))
        values, counts = values[often], counts[often]
        full, at = _by_shard(values, edges)
        return pa.table(
            [
                pa.array(np.full(len(full), chunk.id)),
                pa.array(full.astype(np.int32)),
                pa.array([pack_sorted(values[at[s] : at[s + 1]]) for s in full], pa.binary()),
                pa.array([pack(counts[at[s] : at[s + 1]]) for s in full], pa.binary()),
            ],
            names=["chunk", "shard", "values", "counts"],
        )

    def answer(table: pa.Table) -> pa.Table:
        counts = np.concatenate([unpack(x.as_py()) for x in table.column("counts")])
        return _summed(table, counts, pack, "totals")

    asked = "chunk bigint, shard int, values binary, counts binary"
    flags = cut(chunks.mapInArrow(ask, asked).groupBy("shard").applyInArrow(repeats, "chunk bigint, shard int, flags binary"))
    whole = with_chunk(chunks, flags, ask_whole, asked)
    answers = whole.groupBy("shard").applyInArrow(answer, "chunk bigint, shard int, totals binary")
    none = F.lit(None).cast("binary")
    return flags.select("chunk", "shard", "flags", none.alias("totals")).union(answers.select("chunk", "shard", none, "totals"))


def _repeated(table: pa.Table, n: int) -> np.ndarray:
    """Which of a chunk's n distinct items occur more often than once."""
    order = np.argsort(table.column("shard").to_numpy())
    return np.concatenate([np.zeros(0, bool), *[_flags(table.column("flags")[int(i)].as_py()) for i in order]]) if len(order) else np.zeros(n, bool)


def with_chunk(chunks: DataFrame, answers: DataFrame, use: Callable[[Chunk, pa.Table], pa.Table], schema) -> DataFrame:
    """use(chunk, the answers with its number) for every chunk; chunks stay where they are."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = use(Chunk(left), right)
        tidy()
        return out

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def per_chunk(chunks: DataFrame, answers: DataFrame, use: Callable[[Chunk, np.ndarray], pa.Table], schema) -> DataFrame:
    """use(chunk, totals of its distinct items in ascending order) for every chunk."""

    def run(chunk: Chunk, got: pa.Table) -> pa.Table:
        flagged = pc.is_valid(got.column("flags"))
        often = _repeated(got.filter(flagged), 0)
        total = np.ones(len(often), dtype=np.uint64)
        whole = got.filter(pc.invert(flagged))
        if whole.num_rows:
            order = np.argsort(whole.column("shard").to_numpy())
            total[often] = np.concatenate([unpack(whole.column("totals")[int(i)].as_py()) for i in order])
        return use(chunk, total)

    return with_chunk(chunks, answers, run, schema)
