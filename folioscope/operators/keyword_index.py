"""Persisted keyword index: postings in parts of chunks, searched with the parts' greatest frequencies.

Chunks are dealt to blocks by a hash of their key, and a number of blocks make a bucket, which is a
partition of the table.  A block is cut into parts of bounded size.  For each term a part holds one
row: the greatest frequency, and the numbers and frequencies of its chunks; the keys of the chunks
stand once for a part, in a row without a term.  All terms share the parts, so the sum over a query's
terms of greatest frequency times idf bounds the score of every chunk of a part.  A search reads the
bounds, scores the parts of the best bounds for a first threshold, and then only the parts that reach
it.  Its result is that of a search over all postings.

Texts are shuffled once, by block, and a task writes the parts of its blocks as it reads; a search
shuffles the rows of the asked terms once, by part.  Neither makes a row for each posting.

An upsert or a removal rewrites the buckets of its chunks only; two writers of different buckets
don't disturb each other, and of the same bucket no change is lost (`PartitionedTable`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as tx
from ..functions.batches import changes, word_pieces
from ..sources.log import PartitionedTable
from ..sources.store import text_parts_of
from .retrieval import Best, inverse_frequency, score_matrices, term_blocks, top, weights

#: Of a query's parts the best ones that are scored for its first threshold.
FIRST_PARTS = 4
#: Chunks of a part (their numbers are short), and bytes of words, with 8 for each, after which a part ends.
PART_CHUNKS, PART_BYTES = 1 << 13, 1 << 25
#: Tasks for each split of the texts: a task sorts the rows of its parts, which are several times larger.
BUILD_TASKS = 4
#: By how much a bound may miss a threshold, which is a sum in another order.
NEAR = 1e-6


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each part, of batches sorted by block and part, their first columns."""
    held, at = [], None
    for batch in batches:
        if not len(batch):
            continue
        block, part = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(batch)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if held and at != (block[a], part[a]):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, z - a))
            at = block[a], part[a]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The items of lists, and how many each list has."""
    whole = lists.combine_chunks()
    return np.asarray(whole.flatten(), dtype=np.int64), np.asarray(pc.list_value_length(whole), dtype=np.int64)


def _posts(part: pa.Table, head: str) -> tuple[pa.Array, pa.Table]:
    """The keys of a part's chunks, and its rows of terms; `head` is null in the row of the keys."""
    is_head = part.column(head).is_null()
    return part.column("keys").filter(is_head).combine_chunks().flatten(), part.filter(pc.invert(is_head))


def blocks_of(chunks: DataFrame, buckets: int = 16) -> int:
    """Blocks for each bucket of an index that is made for these chunks, 16 or as many as keep a block within half a split."""
    return max(16, -(-text_parts_of(chunks) // buckets))


class KeywordIndex:
    """The index of a chunk table in a folder; key: chunk key of any type."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 16, blocks: int = 16) -> None:
        """blocks: of each bucket; both numbers stay as they are for the life of an index."""
        self.spark, self.key, self.buckets, self.blocks = spark, key, buckets, blocks
        self.table = PartitionedTable(spark, path)

    def _block(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets * self.blocks)).cast("int")

    def _bucket(self, block: Column) -> Column:
        return F.floor(block / self.blocks).cast("int")

    def _rows(self, held: DataFrame, words: Column, tasks: int) -> DataFrame:
        """The rows of the parts of these chunks (block, k, and what `words` is made of); rows of one key are one chunk."""
        tasks = min(tasks, self.buckets * self.blocks)
        task = F.floor(F.col("block") * F.lit(tasks) / F.lit(self.buckets * self.blocks)).cast("int")
        dealt = held.repartitionById(tasks, task).sortWithinPartitions("block", "k").select("block", "k", words.alias("words"))
        kind = held.schema["k"].dataType
        fields = [("block", T.IntegerType()), ("part", T.IntegerType()), ("term", T.StringType()), ("max_tf", T.LongType()), ("n", T.LongType()), ("at", T.ArrayType(T.ShortType())), ("tf", T.ArrayType(T.IntegerType())), ("keys", T.ArrayType(kind))]
        schema = T.StructType([T.StructField(n, t) for n, t in fields])
        kinds = [to_arrow_type(t) for _, t in fields]

        def made(block: int, part: int, words: list[pa.Array], at: list[np.ndarray], keys: list[pa.Array]) -> Iterator[pa.RecordBatch]:
            """The row of a part's keys, then the rows of its terms."""
            coded, chunk, held = pc.dictionary_encode(pa.concat_arrays(words)), np.concatenate(at), pa.concat_arrays(keys)
            order = np.asarray(pc.sort_indices(coded.dictionary))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            pairs, tf = np.unique(rank[np.asarray(coded.indices)] * len(held) + chunk, return_counts=True)
            term, chunk = np.divmod(pairs, len(held))
            begin = np.searchsorted(term, np.arange(len(order)))
            lists = pa.array(np.append(begin, len(term)), pa.int32())
            rows = {"term": coded.dictionary.take(pa.array(order)), "max_tf": pa.array(np.maximum.reduceat(tf, begin)), "n": pa.array(np.diff(np.append(begin, len(term)))), "at": pa.ListArray.from_arrays(lists, pa.array(chunk.astype(np.int16))), "tf": pa.ListArray.from_arrays(lists, pa.array(tf.astype(np.int32)))}
            head = {"n": pa.array([len(held)], pa.int64()), "keys": pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)}
            for count, some in ((1, head), (len(order), rows)):
                every = {"block": pa.array(np.full(count, block, np.int32)), "part": pa.array(np.full(count, part, np.int32))} | some
                yield pa.RecordBatch.from_arrays([every[n].cast(t) if n in every else pa.nulls(count, t) for (n, _), t in zip(fields, kinds, strict=True)], names=schema.names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, part, chunks, size = None, 0, 0, 0
            words: list[pa.Array] = []
            at: list[np.ndarray] = []
            keys: list[pa.Array] = []
            last = None
            for piece in word_pieces(batches, 2):
                # chunks without terms are not in it
                piece = piece.filter(pc.fill_null(pc.greater(pc.list_value_length(piece.column(2)), 0), False))
                if not len(piece):
                    continue
                blocks, ks, lists = np.asarray(piece.column(0)), piece.column(1), piece.column(2)
                other = changes(pa.concat_arrays([ks.slice(0, 1) if last is None else last, ks]))[1:]
                moved = blocks != np.concatenate([[blocks[0] if block is None else block], blocks[:-1]])
                other |= moved
                other[0] |= last is None
                lengths = np.asarray(pc.list_value_length(lists), dtype=np.int64)
                upto = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(lists.flatten()), dtype=np.int64) + 8)])
                sizes = np.diff(upto[np.concatenate([[0], np.cumsum(lengths)])])
                a = 0
                while a < len(piece):
                    # a part ends with its block, or before a chunk when it is full
                    if chunks and other[a] and (moved[a] or chunks >= PART_CHUNKS or size >= PART_BYTES):
                        yield from made(block, part, words, at, keys)
                        part = 0 if moved[a] else part + 1
                        chunks, size, words, at, keys = 0, 0, [], [], []
                    block = int(blocks[a])
                    number = chunks + np.cumsum(other[a:]) - 1
                    full = (number >= PART_CHUNKS) | (size + np.cumsum(sizes[a:]) - sizes[a:] >= PART_BYTES)
                    stop = np.flatnonzero((moved[a:] | (full & other[a:]))[1:])
                    z = a + 1 + int(stop[0]) if len(stop) else len(piece)
                    some = lists.slice(a, z - a)
                    words.append(some.flatten())
                    at.append(np.repeat(number[: z - a], lengths[a:z]))
                    keys.append(ks.slice(a, z - a).filter(pa.array(other[a:z])))
                    chunks, size, a = int(number[z - a - 1]) + 1, size + int(sizes[a:z].sum()), z
                last = ks.slice(len(ks) - 1)
            if chunks:
                yield from made(block, part, words, at, keys)

        rows = dealt.mapInArrow(run, schema)
        # sorted by term, so that the statistics of the files tell which parts may hold an asked one
        return rows.select(self._bucket(F.col("block")).alias("bucket"), *schema.names).sortWithinPartitions("bucket", "term", "block", "part")

    def _chunks(self, rows: DataFrame) -> DataFrame:
        """block, k, words of the chunks of an index's rows; words with repeats."""
        schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("k", rows.schema["keys"].dataType.elementType), T.StructField("words", T.ArrayType(T.StringType()))])
        kind = to_arrow_type(schema["k"].dataType)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _by_part(batches):
                keys, posts = _posts(part, "term")
                (at, n), (tf, _) = _flat(posts.column("at")), _flat(posts.column("tf"))
                order = np.argsort(at, kind="stable")
                at, tf, term = at[order], tf[order], np.repeat(np.arange(len(n)), n)[order]
                words = posts.column("term").combine_chunks().take(pa.array(np.repeat(term, tf)))
                begin = np.concatenate([[0], np.cumsum(np.bincount(at, tf, len(keys)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), part.column("block")[0].as_py(), np.int32)), keys.cast(kind), pa.ListArray.from_arrays(pa.array(begin), words)], names=schema.names)

        return self._dealt(rows, rows.select("block", "part", "term", "at", "tf", "keys")).mapInArrow(run, schema)

    def _dealt(self, table: DataFrame, rows: DataFrame) -> DataFrame:
        """The rows of each part together, in as many tasks as the table has splits, or cores."""
        tasks = max(self.spark.sparkContext.defaultParallelism, table.rdd.getNumPartitions())
        return rows.repartition(tasks, "block", "part").sortWithinPartitions("block", "part")

    def build(self, chunks: DataFrame, text: str) -> None:
        """Indexes all chunks anew; keys are unique, chunks without terms are not in it."""
        held = chunks.select(self._block(F.col(self.key)).alias("block"), F.col(self.key).alias("k"), F.col(text).alias("text"))
        self.table.change(list(range(self.buckets)), lambda _: self._rows(held, tx.terms(F.col("text")), text_parts_of(chunks, BUILD_TASKS)))

    def upsert(self, chunks: DataFrame, text: str) -> list[int]:
        """Replaces the postings of these chunks, new or known; the buckets that were rewritten.

        A chunk whose text is null or has no terms is removed.
        """
        touched = [r[0] for r in chunks.select(self._bucket(self._block(F.col(self.key))).alias("b")).distinct().collect()]  # at most `buckets`
        changed = chunks.select(F.col(self.key).alias("k")).distinct()
        fresh = chunks.where(F.col(text).isNotNull()).select(self._block(F.col(self.key)).alias("block"), F.col(self.key).alias("k"), tx.terms(F.col(text)).alias("words"))

        def edit(rows: DataFrame | None) -> DataFrame:
            held, tasks = fresh, text_parts_of(chunks, BUILD_TASKS)
            if rows is not None:
                held = self._chunks(rows).join(changed, "k", "left_anti").select("block", "k", "words").unionByName(fresh)
                tasks = max(tasks, text_parts_of(rows, BUILD_TASKS))
            return self._rows(held, F.col("words"), tasks)

        if touched:
            self.table.change(touched, edit)
        return sorted(touched)

    def remove(self, keys: DataFrame) -> list[int]:
        """Removes chunks by key; the buckets that were rewritten."""
        return self.upsert(keys.select(self.key, F.lit(None).cast("string").alias("__none")), "__none")

    def total(self) -> int:
        """Number of chunks with terms."""
        rows = self.table.read()
        return 0 if rows is None else rows.where("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def search(self, queries: DataFrame, query_key: str, query_text: str, limit: int, total: int | None = None, prune: bool = True) -> DataFrame:
        """query_key, key, score, rank: as `keyword_search` finds them by tf x idf.

        total: the number of chunks with terms, where it is known.  Queries go out in blocks, as there.
        """
        rows, out = self.table.read(), None
        if rows is not None:
            total = self.total() if total is None else total
            for names, asked in term_blocks(queries, query_key, query_text):
                found = self._found(rows, names, asked, queries.schema[query_key].dataType, limit, total, prune)
                part = top(found.select(F.col("q.q").alias(query_key), F.col("k").alias(self.key), "score"), query_key, self.key, limit)
                out = part if out is None else out.unionByName(part)
        if out is None:
            none = queries.limit(0).select(query_key, F.lit(None).cast("long" if rows is None else rows.schema["keys"].dataType.elementType).alias(self.key))
            return none.withColumns({"score": F.lit(0.0), "rank": F.lit(0)})
        return out

    def _found(self, rows: DataFrame, names: list, asked: list[list[str]], name: T.DataType, limit: int, total: int, prune: bool) -> DataFrame:
        """q (number and key of the query), k, score: the best chunks of a block of queries, a few of each task."""
        terms = sorted({t for x in asked for t in x})
        number = F.broadcast(self.spark.createDataFrame([*((t, i) for i, t in enumerate(terms)), (None, -1)], "ask string, id int"))
        # a part's row of keys has no term, and goes with those of the asked ones
        posts = rows.join(number, F.col("term").eqNullSafe(F.col("ask"))).select("block", "part", F.when(F.col("id") >= 0, F.col("id")).alias("id"), "max_tf", "n", "at", "tf", "keys")
        heads = posts.where(F.col("id").isNotNull())
        df = {r[0]: r[1] for r in heads.groupBy("id").agg(F.sum("n")).collect()}
        shared = self.spark.sparkContext.broadcast((names, *weights(terms, asked, df, total)))
        if not prune:
            return self._scored(rows, posts, shared, name, limit)
        key = F.struct("block", "part")
        bounds = heads.groupBy(key.alias("k")).agg(F.collect_list("id").alias("ids"), F.collect_list("max_tf").alias("tf"))
        kind = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("k", bounds.schema["k"].dataType), T.StructField("score", T.DoubleType())])
        best = top(bounds.mapInArrow(_best_parts(shared, kind), kind), "q", "k", FIRST_PARTS).select("k.*").distinct().collect()  # a few for each query of the block
        first = F.broadcast(self.spark.createDataFrame(best, "block int, part int"))
        found = self._scored(rows, posts.join(first, ["block", "part"], "left_semi"), shared, name, limit)
        # read for the thresholds and again for the hits
        found = top(found, "q", "k", limit).drop("rank").persist()
        # a query with fewer rows than it wants has no threshold yet
        least = np.full(len(names), -np.inf)
        for q, s in found.groupBy("q.n").agg(F.min("score")).where(F.count("*") == limit).collect():
            least[q] = s
        open_ = bounds.mapInArrow(_reaching(shared, self.spark.sparkContext.broadcast(least), kind["k"].dataType), T.StructType([kind["k"]])).select("k.*").join(first, ["block", "part"], "left_anti")
        # parts that some query opens; scoring them for the others as well doesn't change what these find
        return found.unionByName(self._scored(rows, posts.join(F.broadcast(open_), ["block", "part"], "left_semi"), shared, name, limit))

    def _scored(self, table: DataFrame, posts: DataFrame, shared: Broadcast, name: T.DataType, limit: int) -> DataFrame:
        """The best chunks of these rows for each query.  A part's rows meet in one task, which adds up pairs of query and chunk in matrices."""
        names_ = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("q", name)])
        schema = T.StructType([T.StructField("q", names_), T.StructField("k", posts.schema["keys"].dataType.elementType), T.StructField("score", T.DoubleType())])
        kinds = [to_arrow_type(f.dataType) for f in schema]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, first, query, idf = shared.value
            best, every = Best(len(names), limit, kinds[1]), np.arange(len(names))
            for part in _by_part(batches):
                keys, posts = _posts(part, "id")
                if not len(posts):
                    continue
                (at, n), (tf, _) = _flat(posts.column("at")), _flat(posts.column("tf"))
                term = np.repeat(np.asarray(posts.column("id"), dtype=np.int64), n)
                order = np.argsort(at * len(idf) + term)
                at, term, tf = at[order], term[order], tf[order]
                for row, end, score in score_matrices(at, term, tf * idf[term], len(keys), first, query, len(names)):
                    best.add(every, score, keys.slice(row, end - row))
            asked = pa.StructArray.from_arrays([pa.array(every, pa.int32()), pa.array(names, kinds[0].field("q").type)], fields=list(kinds[0]))
            yield best.rows(asked, schema.names)

        return self._dealt(table, posts.select("block", "part", "id", "at", "tf", "keys")).mapInArrow(run, schema)

    def blocks_read(self, queries: DataFrame, query_key: str, query_text: str, limit: int) -> tuple[int, int]:
        """Parts of terms that a search opens, and those that hold an asked term at all."""
        rows, total = self.table.read(), self.total()
        asked = queries.select(query_key, F.explode(F.array_distinct(tx.terms(F.col(query_text)))).alias("term"))
        heads = rows.where("term IS NOT NULL").select("block", "part", "term", "max_tf", "n")
        df = heads.groupBy("term").agg(F.sum("n").alias("df"))
        weight = asked.join(df, "term").select(query_key, "term", inverse_frequency(F.lit(total), F.col("df")).alias("idf"))
        pairs = weight.join(heads, "term")
        bound = pairs.groupBy(query_key, "block", "part").agg(F.sum(F.col("max_tf") * F.col("idf")).alias("bound"))
        least = self.search(queries, query_key, query_text, limit).groupBy(query_key).agg(F.when(F.count("*") == limit, F.min("score")).alias("least"))
        open_ = bound.join(least, query_key, "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - NEAR))
        return pairs.join(open_, [query_key, "block", "part"], "left_semi").count(), pairs.count()


def _bound_matrices(batch: pa.RecordBatch, first: np.ndarray, query: np.ndarray, idf: np.ndarray, queries: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Bounds of parts (k, ids, tf) by query; minus infinity where a part holds no asked term."""
    ids = batch.column("ids")
    at, term = np.asarray(pc.list_parent_indices(ids), dtype=np.int64), np.asarray(ids.flatten(), dtype=np.int64)
    return score_matrices(at, term, np.asarray(batch.column("tf").flatten()) * idf[term], len(batch), first, query, queries)


def _best_parts(shared: Broadcast, schema: T.StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The parts of the best bounds of each query."""
    kind = to_arrow_type(schema["k"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, query, idf = shared.value
        best, every = Best(len(names), FIRST_PARTS, kind), np.arange(len(names))
        for batch in batches:
            for a, z, bound in _bound_matrices(batch, first, query, idf, len(names)):
                best.add(every, bound, batch.column("k").slice(a, z - a).cast(kind))
        yield best.rows(pa.array(every, pa.int32()), schema.names)

    return run


def _reaching(shared: Broadcast, least: Broadcast, part: T.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The parts whose bound reaches the threshold of some query."""
    kind = to_arrow_type(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, query, idf = shared.value
        for batch in batches:
            for a, z, bound in _bound_matrices(batch, first, query, idf, len(names)):
                fine = ((bound >= least.value - NEAR) & (bound > -np.inf)).any(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(a, z - a).cast(kind).filter(pa.array(fine))], names=["k"])

    return run
