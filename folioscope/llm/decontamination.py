"""Benchmark decontamination: which words of a document lie in a window of a benchmark item.

A window is `WINDOW` consecutive words of an item; a shorter item (of one word at least) is one
window.  Prefix-filtered set join: a window is the set of its word shingles.  Containment asks
for all of them, so a single one, the rarest, is a sufficient prefix.  Documents' shingles are
joined with these prefix shingles; the place of the shingle in the window gives the only place
where the window can begin (positional bound), the document's ends bound it (length bound), and
the window is verified there word by word, by bytes.

The prefix index is broadcast while its size stays under a bound.  Beyond it, documents emit
their matching places (thinned by a fixed-size Bloom filter) and a shuffled join on the shingle
finds and verifies the windows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import BROADCAST_BYTES, cut
from .words import LETTERS, Words, mix, pieces, shingles, split_words

WINDOW, SHINGLE = 13, 3
U64 = np.uint64


def _windows(w: Words, r: int) -> list[tuple[int, int]]:
    a, b = int(w.first[r]), int(w.first[r + 1])
    if a == b:
        return []
    return [(i, min(i + WINDOW, b)) for i in range(a, max(a + 1, b - WINDOW + 1))]


def windows_of(bench: DataFrame, key: str, text: str) -> DataFrame:
    """window (its words joined by a space), item, hashes of its words: distinct.  No null keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "t"):
            w = split_words(piece.column(1), LETTERS)
            keys, items, texts, hashes = piece.column(0).to_pylist(), [], [], []
            for r in range(len(w.first) - 1):
                for a, b in _windows(w, r):
                    items.append(keys[r])
                    texts.append(b" ".join(w.data[w.start[i] : w.end[i]].tobytes() for i in range(a, b)))
                    hashes.append(w.hash[a:b].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(items, pa.string()), pa.array(hashes, pa.list_(pa.int64()))], names=["window", "item", "h"])

    source = bench.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    return source.mapInArrow(run, "window binary, item string, h array<bigint>").distinct()


def _gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    return shingles(h, np.array([0, len(h)]), size, short=False)[0]


class Index:
    """Windows by their rarest shingle, for one width of shingle at a time."""

    def __init__(self, rows: list) -> None:
        by_window: dict[bytes, tuple[np.ndarray, set]] = {}
        for window, item, h in rows:
            by_window.setdefault(bytes(window), (np.array(h, dtype=np.int64).view(U64), set()))[1].add(item)
        self.texts = list(by_window)
        self.words = [by_window[x][0] for x in self.texts]
        self.items = [frozenset(by_window[x][1]) for x in self.texts]
        grams = [_gram_hashes(h, min(SHINGLE, len(h))) for h in self.words]
        often = Counter(x for g in grams for x in g.tolist())
        self.widths = {}
        for width in range(1, SHINGLE + 1):
            of = [k for k, h in enumerate(self.words) if min(SHINGLE, len(h)) == width]
            entries = []
            for k in of:
                rare = min(range(len(grams[k])), key=lambda i: (often[int(grams[k][i])], int(grams[k][i]), i))
                entries.append((int(grams[k][rare]), rare, k))
            if entries:
                entries.sort()
                sig = np.array([e[0] for e in entries], dtype=U64)
                # a table of flags by the low bits leaves few binary searches
                flags = np.zeros(1 << 20, dtype=bool)
                flags[(sig & U64((1 << 20) - 1)).astype(np.int64)] = True
                whole = np.array([_whole(self.words[e[2]]) for e in entries], dtype=U64)
                length = np.array([len(self.words[e[2]]) for e in entries])
                self.widths[width] = (sig, np.array([e[1] for e in entries]), np.array([e[2] for e in entries]), flags, whole, length)

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start (in w) and window number of all verified occurrences."""
        rows, starts, found = [], [], []
        n = np.diff(w.first)
        for width, (sig, offset, window, flags, whole, length) in self.widths.items():
            h, first = shingles(w.hash, w.first, width, short=False)
            hit = np.flatnonzero(flags[(h & U64((1 << 20) - 1)).astype(np.int64)])
            if not len(hit):
                continue
            lo, hi = np.searchsorted(sig, h[hit], "left"), np.searchsorted(sig, h[hit], "right")
            hit, lo, hi = hit[hi > lo], lo[hi > lo], hi[hi > lo]
            if not len(hit):
                continue
            entry = np.repeat(lo, hi - lo) + (np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo))
            hit = np.repeat(hit, hi - lo)
            row = np.searchsorted(first, hit, side="right") - 1
            start = hit - first[row] - offset[entry]  # in the row
            fits = (start >= 0) & (start + length[entry] <= n[row])
            row, start, entry = row[fits], start[fits] + w.first[row[fits]], entry[fits]
            same = _whole_at(w.hash, start, length[entry]) == whole[entry]
            row, start, entry = row[same], start[same], entry[same]
            for r, s, k in zip(row.tolist(), start.tolist(), window[entry].tolist(), strict=True):
                if b" ".join(w.data[w.start[i] : w.end[i]].tobytes() for i in range(s, s + len(self.words[k]))) == self.texts[k]:
                    rows.append(r)
                    starts.append(s)
                    found.append(k)
        return np.array(rows, dtype=np.int64), np.array(starts, dtype=np.int64), np.array(found, dtype=np.int64)


_AT = mix(np.arange(1, WINDOW + 1, dtype=U64)) | U64(1)


def _whole(h: np.ndarray) -> U64:
    with np.errstate(over="ignore"):
        return (h * _AT[: len(h)]).sum(dtype=U64)


def _whole_at(h: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start), dtype=U64)
    with np.errstate(over="ignore"):
        for i in range(WINDOW):
            inside = length > i
            out[inside] += h[start[inside] + i] * _AT[i]
    return out


def _digest(items: set) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _verdict(n: int, hits: int) -> bool:
    return hits > 0 and 20 * hits >= n


def _judge(w: Words, index: Index) -> tuple[np.ndarray, list[set]]:
    """Hit words and items of each row."""
    rows, starts, found = index.find(w)
    items: list[set] = [set() for _ in range(len(w.first) - 1)]
    cover = np.zeros(len(w.hash) + 1, dtype=np.int64)
    for r, s, k in zip(rows.tolist(), starts.tolist(), found.tolist(), strict=True):
        cover[s] += 1
        cover[s + len(index.words[k])] -= 1
        items[r] |= index.items[k]
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
    return hit[w.first[1:]] - hit[w.first[:-1]], items


def _index_if_small(windows: DataFrame, limit: int) -> Index | None:
    size = windows.agg(F.sum(F.length("window") + F.length("item") + 8 * F.size("h") + 64)).first()[0] or 0
    return Index([tuple(r) for r in windows.collect()]) if size <= limit else None


RESULT = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]


def contaminated(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", limit: int = BROADCAST_BYTES) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated: one row for each row of docs.

    A null or empty text has no words, no items and is clean.  Items with a null id or text have
    no windows (a null id can't be told, so its text is not looked for); an empty benchmark leaves
    all clean.  Null and repeated keys and repeated rows are kept; other columns are ignored,
    whatever their names; texts are read whole, however long.  Shingles equally rare are taken in
    the order of their hashes, which no result depends on; an empty table gives no rows.
    """
    windows = cut(windows_of(bench, item, item_text))
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    index = _index_if_small(windows, limit)
    if index is None:
        return _by_shuffle(source, windows, key)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "t"):
            w = split_words(piece.column(1), LETTERS)
            hits, items = _judge(w, shared.value)
            n = np.diff(w.first)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(n), pa.array(hits), pa.array([len(x) for x in items], pa.int64()), pa.array([_digest(x) for x in items]), pa.array([_verdict(a, b) for a, b in zip(n.tolist(), hits.tolist(), strict=True)], pa.bool_())],
                names=[key, *(f.name for f in RESULT)],
            )

    return source.mapInArrow(run, T.StructType([T.StructField(key, source.schema["k"].dataType), *RESULT]))


#: Bits of the Bloom filter of the shuffled way: 16 MB whatever the benchmark's size.
BLOOM_BITS = 1 << 27
#: Bytes of the filter that are sent at once.
PAGE = 1 << 16


def _by_shuffle(source: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """The same result for a benchmark of any size: prefix shingles are joined in a shuffle."""
    kind = source.schema["k"].dataType

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, off, row = [], [], []
            for i, h in enumerate(batch.column(batch.schema.get_field_index("h")).to_pylist()):
                g = _gram_hashes(np.array(h, dtype=np.int64).view(U64), min(SHINGLE, len(h)))
                sig.append(g.view(np.int64))
                off.append(np.arange(len(g)))
                row.append(np.full(len(g), i))
            take = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig)), pa.array(np.concatenate(off)), *(batch.column(c).take(take) for c in range(batch.num_columns))], names=["sig", "off", *batch.schema.names])

    each = windows.groupBy("window", "h").agg(F.collect_set("item").alias("items")).mapInArrow(grams, "sig bigint, off bigint, window binary, h array<bigint>, items array<string>")
    often = each.groupBy("sig").count()
    prefix = cut(each.join(often, "sig").groupBy("window", "h", "items").agg(F.min(F.struct("count", "sig", "off")).alias("p")).select("window", "h", "items", "p.sig", "p.off"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(BLOOM_BITS // 8, dtype=np.uint8)
        for batch in batches:
            at = (batch.column(0).to_numpy().view(U64) % U64(BLOOM_BITS)).astype(np.int64)
            np.bitwise_or.at(flags, at >> 3, (1 << (at & 7)).astype(np.uint8))
        spots = np.flatnonzero(flags)
        yield pa.RecordBatch.from_arrays([pa.array(spots), pa.array(flags[spots].astype(np.int64))], names=["spot", "bits"])

    def page(table: pa.Table) -> pa.Table:
        flags = np.zeros(PAGE, dtype=np.uint8)
        flags[table.column("spot").to_numpy() % PAGE] = table.column("bits").to_numpy()
        return pa.table([table.column("page")[:1], pa.array([flags.tobytes()], pa.binary())], names=["page", "data"])

    # the filter's bytes come in pages: BLOOM_BITS / 8 bytes in all, however many windows there are
    cells = prefix.select("sig").mapInArrow(bits, "spot bigint, bits bigint").groupBy("spot").agg(F.bit_or("bits").alias("bits"))
    flags = np.zeros(BLOOM_BITS // 8, dtype=np.uint8)
    for at, data in cells.withColumn("page", F.expr(f"spot div {PAGE}")).groupBy("page").applyInArrow(page, "page bigint, data binary").collect():
        flags[at * PAGE : (at + 1) * PAGE] = np.frombuffer(data, dtype=np.uint8)[: len(flags) - at * PAGE]
    shared = source.sparkSession.sparkContext.broadcast(flags)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        done = TaskContext.get().partitionId() << 40
        for piece in pieces(batches, "t"):
            w = split_words(piece.column(1), LETTERS)
            n, out = np.diff(w.first), {"row": [], "k": [], "n": [], "sig": [], "at": [], "near": [], "words": []}
            keys = piece.column(0)
            for r in range(len(n)):  # a row of its own keeps documents without places
                out["row"].append(done + r), out["n"].append(int(n[r])), out["k"].append(r)
                out["sig"].append(None), out["at"].append(None), out["near"].append(None), out["words"].append(None)
            for width in range(1, SHINGLE + 1):
                h, first = shingles(w.hash, w.first, width, short=False)
                at = (h % U64(BLOOM_BITS)).astype(np.int64)
                for p in np.flatnonzero(shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).tolist():
                    r = int(np.searchsorted(first, p, side="right")) - 1
                    i = p - int(first[r])
                    lo, hi = max(0, i - WINDOW), min(int(n[r]), i + WINDOW)
                    out["row"].append(done + r), out["n"].append(int(n[r])), out["k"].append(r)
                    out["sig"].append(int(h[p].view(np.int64))), out["at"].append(i), out["near"].append(lo)
                    out["words"].append([w.word(int(w.first[r]) + j) for j in range(lo, hi)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["row"], pa.int64()), keys.take(pa.array(out["k"], pa.int64())), pa.array(out["n"], pa.int64()), pa.array(out["sig"], pa.int64()), pa.array(out["at"], pa.int64()), pa.array(out["near"], pa.int64()), pa.array(out["words"], pa.list_(pa.string()))],
                names=["row", "k", "n", "sig", "at", "near", "words"],
            )
            done += piece.num_rows

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("k", kind), *(T.StructField(x, T.LongType()) for x in ("n", "sig", "at", "near")), T.StructField("words", T.ArrayType(T.StringType()))])
    places = cut(source.mapInArrow(emit, schema))
    size = F.size("h")
    start = F.col("at") - F.col("off")
    inside = F.slice("words", (start - F.col("near") + 1).cast("int"), size)
    hits = places.where("sig is not null").join(prefix, "sig").where((start >= 0) & (start + size <= F.col("n")))
    hits = hits.where(F.encode(F.array_join(inside, " "), "UTF-8") == F.col("window")).select("row", "items", start.alias("a"), (start + size).alias("b"))
    before = F.max("b").over(_before())
    covered = hits.select("row", "a", "b").distinct().withColumn("done", F.coalesce(before, F.lit(0))).groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("b") - F.greatest("a", "done"))).alias("hit"))
    items = hits.select("row", F.explode("items").alias("item")).distinct().groupBy("row").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("ids"))
    docs = places.where("sig is null").select("row", F.col("k").alias(key), F.col("n").alias("n_words"))
    out = docs.join(covered, "row", "left").join(items, "row", "left").na.fill({"hit": 0, "n_items": 0, "ids": ""})
    return out.select(key, "n_words", F.col("hit").alias("n_hit"), "n_items", F.sha2("ids", 256).alias("items_sha256"), ((F.col("hit") > 0) & (20 * F.col("hit") >= F.col("n_words"))).alias("contaminated"))


def _before():
    from pyspark.sql import Window

    return Window.partitionBy("row").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)


def drop_contaminated(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", limit: int = BROADCAST_BYTES) -> DataFrame:
    """docs without the contaminated rows.  All columns are kept as they are; a null text stays."""
    windows = cut(windows_of(bench, item, item_text))
    index = _index_if_small(windows, limit)
    if index is None:
        texts = cut(docs.select(F.col(text).alias("t")).where("t is not null").distinct())
        bad = contaminated(texts.select(F.sha2("t", 256).alias("k"), "t"), bench, "k", "t", item, item_text, limit).where("contaminated").select(F.col("k").alias("__bad"))
        return docs.join(bad, F.sha2(docs[text], 256) == bad["__bad"], "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            w = split_words(piece.column(piece.schema.get_field_index(text)), LETTERS)
            hits, _ = _judge(w, shared.value)
            n = np.diff(w.first)
            yield piece.filter(pa.array(~((hits > 0) & (20 * hits >= n))))

    return docs.mapInArrow(run, docs.schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SPLIT = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
SQL = rf"""
WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
b AS (SELECT item_id, {_SPLIT} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, w[i : i + 12] AS v
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(v) AS m FROM win),
spans AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d JOIN lens ON len(w) >= m),
occ AS (SELECT doc_id, i, m, item_id FROM (SELECT doc_id, i, m, w[i : i + m - 1] AS v FROM spans) JOIN win USING (v)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM occ)) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM occ) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

QUERIES = {"op4_decontamination": op4_decontamination}
ORACLE_SQL = {"op4_decontamination": SQL}
