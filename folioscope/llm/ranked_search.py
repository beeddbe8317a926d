"""Ranked lexical search: exact top-k over dual-sorted wavelet trees, one for each shard.

A shard is a bounded run of documents.  The postings of each of its terms lie in a row by falling
impact; all lists in a row are a sequence of document numbers (places in the order of doc_id), kept
as the levels of a wavelet tree.  A node of the tree is a range of documents, and a term's postings
in it are a range again, still by falling impact: the first is the greatest.  So the sum over the
terms of weight times first impact bounds the score of every document below a node.  Search opens
the nodes of the best bound first, many at a time in one matrix of terms by nodes; a leaf is one
document with its exact score.  It ends when k leaves beat every bound that is left, equal scores by
ascending doc_id.

The index is a table in the shared folder: a row for each shard, with its own dictionary.  Building
it reads the documents twice and shuffles nothing: once for the counts N and L, on which impacts
depend, once for the trees.  A search reads dictionaries for document frequencies, then the shards;
a task carries the best k of a query from shard to shard, so that later shards are cut by what
earlier ones hold, and only those go to the final ranking.  Queries come in blocks whose terms are
bounded, each of which reads the index once.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import checkpoint_dir
from .codec import spread
from .words import _LOWER, pieces, text_buffer, tidy

#: Text bytes of a shard, unless one text alone is longer.
SHARD_BYTES = 6 << 20
#: Bytes of the queries' terms in one block, which goes to all executors.
BLOCK_BYTES = 4 << 20
#: Nodes that are opened at once.
AT_ONCE = 32
#: Bytes of a term, after A-Z are lower-cased: `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]`.
TERM = np.ones(256, dtype=bool)
TERM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False

SHARD = T.StructType(
    [
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("terms", T.ArrayType(T.StringType())),
        T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("impacts", T.BinaryType()),
        T.StructField("levels", T.ArrayType(T.BinaryType())),
    ]
)


def terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of a string column in a row, and where each text's begin; null has none."""
    raw, offsets = text_buffer(column)
    data = _LOWER[raw]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = TERM[data]
    opens = inside[1:-1] & ~inside[:-2]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[begins] = inside[1:-1][begins]
    start = np.flatnonzero(opens)
    kept = inside[1:-1]
    before = np.concatenate([[0], np.cumsum(kept)])
    bounds = np.append(before[start], before[-1])
    out = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[kept]))
    return out, np.searchsorted(start, offsets, side="left")


def impacts_of(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """Impact of tf occurrences in documents of n terms; docs and total count the whole corpus."""
    m = 100 - 90 + (90 * n * docs) // total
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def levels_of(sequence: np.ndarray, depth: int) -> list[np.ndarray]:
    """The bits of a wavelet tree from the highest down; each level holds zeros before ones."""
    out = []
    for k in range(depth - 1, -1, -1):
        bit = ((sequence >> k) & 1).astype(bool)
        out.append(bit)
        sequence = np.concatenate([sequence[~bit], sequence[bit]])
    return out


def shard_of(ids: pa.Array, texts: pa.Array, docs: int, total: int) -> dict | None:
    """One shard: its documents by ascending id (null last), terms, impacts and levels.

    Documents without terms are left out.
    """
    terms, first = terms_of(texts)
    n = np.diff(first)
    if not len(terms):
        return None
    order = np.asarray(pc.sort_indices(ids, null_placement="at_end"), dtype=np.int64)
    order = order[n[order] > 0]
    place = np.zeros(len(n), dtype=np.int64)
    place[order] = np.arange(len(order))
    coded = terms.dictionary_encode()
    words = coded.dictionary
    key = np.asarray(coded.indices, dtype=np.int64) * len(order) + np.repeat(place, n)
    key, tf = np.unique(key, return_counts=True)
    word, doc = np.divmod(key, len(order))
    impact = impacts_of(tf.astype(np.int64), n[order][doc], docs, total)
    by = np.lexsort((doc, -impact, word))
    depth = max(1, int(len(order) - 1).bit_length())
    return {
        "doc_ids": ids.take(pa.array(order)),
        "terms": words.cast(pa.string()),
        "sizes": pa.array(np.bincount(word, minlength=len(words)), pa.int32()),
        "impacts": impact[by].astype(np.int32).tobytes(),
        "levels": pa.array([np.packbits(b).tobytes() for b in levels_of(doc[by], depth)], pa.binary()),
    }


class Shard:
    """A shard in memory: for each level the ones before each place and the impacts in its order."""

    def __init__(self, row: dict, asked: pa.Array) -> None:
        """row: the fields of SHARD; asked: the terms of a block of queries; only their lists are kept."""
        self.doc_ids = row["doc_ids"]
        sizes = np.asarray(row["sizes"], dtype=np.int64)
        found = np.asarray(pc.fill_null(pc.index_in(row["terms"], value_set=asked), -1), dtype=np.int64)
        self.start, self.end = np.zeros(len(asked), dtype=np.int64), np.zeros(len(asked), dtype=np.int64)
        has = found >= 0
        lists = (np.cumsum(sizes) - sizes)[has], sizes[has]
        ends = np.cumsum(lists[1])
        self.start[found[has]], self.end[found[has]] = ends - lists[1], ends
        # lists that nobody asks for leave every level; the order of the others stays
        keep = np.zeros(int(sizes.sum()), dtype=bool)
        keep[spread(*lists)] = True
        impact = np.frombuffer(row["impacts"], dtype=np.int32)[keep]
        self.depth = len(row["levels"])
        self.zeros, self.ones, self.impact = [], [], [impact]
        for raw in row["levels"]:
            bit = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=len(keep)).view(bool)
            own = bit[keep]
            keep = np.concatenate([keep[~bit], keep[bit]])
            self.zeros.append(int(len(own) - own.sum()))
            self.ones.append(np.concatenate([[0], np.cumsum(own)]).astype(np.int32))
            impact = np.concatenate([impact[~own], impact[own]])
            self.impact.append(impact)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, best: list[tuple[int, float, int]]) -> None:
        """Puts the shard's best documents for a query into `best`, a heap of at most k.

        An entry is (score, -doc_id, -place); the least of the heap is the first to go.
        """
        here = self.end[terms] > self.start[terms]
        if not here.any():
            return
        a, b, w = self.start[terms][here], self.end[terms][here], weights[here]
        top = int((w * self.impact[0][a]).sum())
        # of equal bounds the node with the smaller documents comes first
        heap = [(-top, 0, 0, a, b)]
        while heap:
            least = best[0] if len(best) == k else None
            by_level: dict[int, list] = {}
            for _ in range(AT_ONCE):
                if not heap:
                    break
                bound, low, level, a, b = heap[0]
                if least is not None and -bound < least[0] or bound == 0:
                    heap.clear()
                    break
                heapq.heappop(heap)
                if level < self.depth:
                    by_level.setdefault(level, []).append((low, a, b))
                elif (entry := self._entry(-bound, low)) and (least is None or entry > least):
                    heapq.heappush(best, entry)
                    if len(best) > k:
                        heapq.heappop(best)
                    least = best[0] if len(best) == k else None
            for level, nodes in by_level.items():
                self._open(level, nodes, w, heap, least)

    def _entry(self, score: int, place: int) -> tuple[int, float, int]:
        doc = self.doc_ids[place]
        return (score, -math.inf if doc is None else -doc, -place)

    def _open(self, level: int, nodes: list, w: np.ndarray, heap: list, least: tuple | None) -> None:
        ones, impact = self.ones[level], self.impact[level + 1]
        a, b = np.array([x[1] for x in nodes]), np.array([x[2] for x in nodes])
        one_a, one_b = ones[a], ones[b]
        half = 1 << (self.depth - level - 1)
        for side, (s, e) in enumerate(((a - one_a, b - one_b), (self.zeros[level] + one_a, self.zeros[level] + one_b))):
            first = np.where(e > s, impact[np.minimum(s, len(impact) - 1)], 0)
            bound = first @ w
            for i in np.flatnonzero(bound > 0).tolist():
                low = nodes[i][0] + side * half
                # none below it beats the smallest document there with the whole bound
                if least is None or self._entry(int(bound[i]), low) > least:
                    heapq.heappush(heap, (-int(bound[i]), low, level + 1, s[i], e[i]))


def shards_of(batches: Iterator[pa.RecordBatch], docs: int, total: int) -> Iterator[dict]:
    held, size = [], 0
    for piece in pieces(batches, "t", SHARD_BYTES):
        held.append(piece)
        size += pc.sum(pc.fill_null(pc.binary_length(piece.column(1)), 0)).as_py()
        if size >= SHARD_BYTES:
            table = pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
            if shard := shard_of(table.column(0).combine_chunks(), table.column(1).combine_chunks(), docs, total):
                yield shard
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        if shard := shard_of(table.column(0).combine_chunks(), table.column(1).combine_chunks(), docs, total):
            yield shard
    tidy()


class Index:
    """A built index: the folder of its shards, and the counts of its corpus."""

    def __init__(self, spark: SparkSession, path: str, docs: int, total: int) -> None:
        self.spark, self.path, self.docs, self.total = spark, path, docs, total

    def shards(self) -> DataFrame:
        return self.spark.read.schema(SHARD).parquet(self.path)

    def frequencies(self, asked: pa.Array) -> DataFrame:
        """place (in asked), df: in how many documents each asked term occurs."""
        shared = self.spark.sparkContext.broadcast(asked)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df = np.zeros(len(shared.value), dtype=np.int64)
            for batch in batches:
                terms, sizes = batch.column(0).flatten(), batch.column(1).flatten()
                at = np.asarray(pc.fill_null(pc.index_in(terms.cast(pa.large_string()), value_set=shared.value), -1), dtype=np.int64)
                np.add.at(df, at[at >= 0], np.asarray(sizes, dtype=np.int64)[at >= 0])
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], names=["place", "df"])

        return self.shards().select("terms", "sizes").mapInArrow(run, "place long, df long").groupBy("place").agg(F.sum("df").alias("df"))


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Indexes all rows of docs, in a new folder below the shared one.

    Each row is a document of its own, also where keys or rows repeat or the key is null; null and
    empty texts hold no terms and count nowhere; other columns are ignored, whatever their names.
    A text longer than a shard is a shard of its own.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = every = 0
        for piece in pieces(batches, "t"):
            n = np.diff(terms_of(piece.column(0))[1])
            some, every = some + int((n > 0).sum()), every + int(n.sum())
        yield pa.RecordBatch.from_pydict({"n": [some], "l": [every]}, pa.schema([("n", pa.int64()), ("l", pa.int64())]))

    found = source.select("t").mapInArrow(counts, "n long, l long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("l"), F.lit(0)).alias("l")).first()
    n, total = found.n, found.l
    kind = pa.schema([("doc_ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())), ("impacts", pa.binary()), ("levels", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards_of(batches, n, total):
            columns = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) if isinstance(v, pa.Array) else pa.array([v], pa.binary()) for v in shard.values()]
            yield pa.RecordBatch.from_arrays(columns, schema=kind)

    path = f"{checkpoint_dir(spark)}/ranked-{uuid.uuid4()}"
    source.mapInArrow(run, SHARD).write.parquet(path)
    return Index(spark, path, n, total)


def _blocks(queries: DataFrame, item: str, text: str) -> Iterator[list]:
    """The rows of queries with distinct terms, in blocks of bounded size: (item, terms)."""
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("terms", T.ArrayType(T.StringType()))])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "t"):
            terms, first = terms_of(piece.column(1))
            lists = [sorted(set(terms.slice(a, b - a).to_pylist())) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(lists, pa.list_(pa.string()))], names=["item", "terms"])

    rows = queries.select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).mapInArrow(distinct, schema).where(F.size("terms") > 0)
    spark = queries.sparkSession
    path = f"{checkpoint_dir(spark)}/ranked-queries-{uuid.uuid4()}"
    cost = F.aggregate("terms", F.lit(16), lambda s, x: s + F.octet_length(x) + 16)
    rows.withColumn("bytes", cost.cast("long")).write.parquet(path)
    stored = spark.read.schema(T.StructType([*schema, T.StructField("bytes", T.LongType())])).parquet(path)
    total = stored.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("b")).first().b
    n = -(-total // BLOCK_BYTES)
    if n == 1:
        yield stored.drop("bytes").collect()
        return
    stored = stored.withColumn("block", F.pmod(F.xxhash64("item", "terms"), F.lit(n)))
    for b in range(n):
        # hashing makes blocks uneven, and repeated rows meet: what comes is cut again
        held, size = [], 0
        for row in stored.where(F.col("block") == b).toLocalIterator():
            held.append(row)
            size += row.bytes
            if size >= BLOCK_BYTES:
                yield held
                held, size = [], 0
        if held:
            yield held


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _search_block(index: Index, block: list, k: int) -> DataFrame:
    asked = pa.array(sorted({t for row in block for t in row.terms}), pa.large_string())
    df = {r.place: r.df for r in index.frequencies(asked).collect()}
    place = {t: i for i, t in enumerate(asked.to_pylist())}
    plans = []
    for number, row in enumerate(block):
        at = [i for t in row.terms if (i := place[t]) in df]
        w = [weight(index.docs, df[i]) for i in at]
        plans.append((number, row.item, np.array(at, dtype=np.int64), np.array(w, dtype=np.int64)))
    shared = index.spark.sparkContext.broadcast((asked, plans))
    kind = pa.schema([("number", pa.int64()), ("item", pa.int64()), ("doc", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, plans = shared.value
        best: dict[int, list] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(c)[r] for c, name in enumerate(batch.schema.names)}
                shard = Shard(
                    {
                        "doc_ids": row["doc_ids"].as_py(),
                        "terms": row["terms"].values.cast(pa.large_string()),
                        "sizes": row["sizes"].values,
                        "impacts": row["impacts"].as_buffer(),
                        "levels": [x.as_buffer() for x in row["levels"].values],
                    },
                    asked,
                )
                for number, _, at, w in plans:
                    if len(at):
                        shard.search(at, w, k, best.setdefault(number, []))
                del shard
        items = {number: item for number, item, _, _ in plans}
        out = [(n, items[n], None if d == -math.inf else -d, s) for n, heap in best.items() for s, d, _ in heap]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 4, schema=kind)
        tidy()

    hits = index.shards().mapInArrow(run, "number long, item long, doc long, score long")
    by = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, k: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """item, rank, doc_id, score: the k best documents with a score above 0 for each row of queries.

    Equal scores go by ascending doc_id, null last.  Each row of queries is ranked for itself, also
    where items or rows repeat; a null text or one without terms has no hits, and nothing is found
    in an empty index.  Other columns of queries are ignored.
    """
    blocks = [_search_block(index, block, k) for block in _blocks(queries, item, text)] if index.docs else []
    out = reduce(DataFrame.unionByName, blocks) if blocks else index.spark.createDataFrame([], "number long, item long, doc long, score long, rank int")
    return out.select(F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT row_number() OVER () AS qid, item_id, {_WORDS} AS ws FROM benchmark),
lens AS (SELECT rid, doc_id, CAST(len(ws) AS BIGINT) AS n FROM d WHERE len(ws) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lens),
q AS (SELECT DISTINCT qid, item_id, unnest(ws) AS term FROM b),
tf AS (SELECT rid, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, unnest(ws) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY rid, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
scored AS (SELECT qid, item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN lens USING (rid), total GROUP BY qid, item_id, rid, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS r FROM scored WHERE score > 0)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= 10
"""

QUERIES = {"op11_ranked_search": op11_ranked_search}
ORACLE_SQL = {"op11_ranked_search": SQL}
