"""N-gram Jaccard join: documents whose word-shingle sets have a Jaccard similarity from a threshold on.

1. The corpus is chunked (exchange.py), and every distinct shingle of a chunk learns in how many
   documents of the corpus it occurs.  A link needs the share `t` of a document's shingles to be
   shared, so a document with fewer shared ones is settled at once: it has no link.
2. Equal sets collapse into a class; one member stands for it.
3. A linked pair has one of the rarest (1 - t) n + 1 shingles of either in common.  Documents
   joined by such shingles make up blocks.  A block of few documents is searched as one group; of
   a large one first its tiles, each together with some documents of the whole block, which
   connects large groups of near copies.
4. In large blocks each rare shingle with holders of different components is a group of its own:
   the holders in its largest component against the others, in tiles, and the others among
   themselves.  So no task grows with a block, and no pair is asked for that is connected already.
5. In a group, T-occurrence search: the short inverted lists of a document's shingles are
   merged, the long ones are probed by binary search for what the merge has left
   (DivideSkip); documents that reach the required overlap link.  A group returns a spanning
   forest of its links, so links are never listed pair by pair.
6. Components of the forests' edges.

All steps are exact, whatever the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import cut
from .codec import spread
from .exchange import Chunk, chunked, per_chunk, totals, with_chunk
from .graph import Forest, components
from .words import SPACED, mix, shingles, tidy

#: Documents of a tile, and how many of a large block are in all its tiles, about.
TILE, PIVOTS = 128, 32
#: Sets that are probed for at a time.
PROBES = 16
#: Weight of a probe against a merge step in the choice of how many lists are long.
MU = 0.3


def _distinct(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, ascending in a row, and where each row's begin."""
    s, f = shingles(h, first, n)
    row = np.repeat(np.arange(len(f) - 1), np.diff(f))
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    return s[keep], np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(f) - 1))])


def _overlap(n: int, percent: int) -> int:
    """The least overlap of a set of n items with any set that it links with."""
    return -(-percent * n // 100)


class Lists:
    """Inverted lists of some sets: the places of the sets that hold an item, ascending."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        items = np.concatenate([np.zeros(0, np.uint64), *sets])
        place = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.lexsort((place, items))
        items, self.place = items[order], place[order].astype(np.int32)
        new = np.ones(len(items), dtype=bool)
        new[1:] = items[1:] != items[:-1]
        self.n, self.items = len(sets), items[new]
        self.first = np.concatenate([np.flatnonzero(new), [len(items)]])
        #: (list, place) of every entry, as ascending numbers
        self.entry = (np.cumsum(new) - 1) * self.n + self.place

    def divide_skip(self, query: np.ndarray, need: int | np.ndarray, done: Callable[[int], bool] = lambda place: False) -> Iterator[int]:
        """Places of sets that hold at least `need` items of the query, and of which `done` isn't true.

        need: one number, or one for each place.  The longest lists (fewer than the least of them) are
        set aside.  The others are merged (sorted in one array, which gives what a heap would), and
        what occurs often enough among them is probed for in the long ones, by binary search, the
        most frequent first, `PROBES` at a time.
        """
        at = np.searchsorted(self.items, query)
        query, at = query[at < len(self.items)], at[at < len(self.items)]
        at = at[self.items[at] == query]
        need = np.broadcast_to(need, self.n)
        least = int(need.min()) if self.n else 1
        if len(at) < least:
            return
        size = self.first[at + 1] - self.first[at]
        order = np.argsort(size, kind="stable")
        at, size = at[order], size[order]
        n_long = min(least - 1, int(least / (MU * log2(max(2, size[-1])) + 1)))
        short, long = at[: len(at) - n_long], at[len(at) - n_long :]
        merged = np.sort(self.place[spread(self.first[short], size[: len(short)])])
        edge = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        found, count = merged[edge], np.diff(np.concatenate([edge, [len(merged)]]))
        likely = np.flatnonzero(count >= need[found] - n_long)
        likely = likely[np.argsort(-count[likely], kind="stable")]
        for i in range(0, len(likely), PROBES):
            some = np.array([k for k in likely[i : i + PROBES].tolist() if not done(int(found[k]))], dtype=np.int64)
            wanted = long * self.n + found[some, None].astype(np.int64)
            spot = np.minimum(np.searchsorted(self.entry, wanted), len(self.entry) - 1)
            enough = count[some] + (self.entry[spot] == wanted).sum(axis=1) >= need[found[some]]
            for x in found[some[enough]].tolist():
                if not done(x):
                    yield x


def _search(percent: int):
    """Searches a group: rows of side 0 against each other, those of side 2 against those of side 1."""

    def run(table: pa.Table) -> pa.Table:
        rid, sizes, side = (table.column(c).to_numpy() for c in ("rid", "n", "side"))
        sets = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in table.column("items")]
        forest = Forest()
        for r, k in zip(rid.tolist(), table.column("known").to_pylist(), strict=True):
            if k is not None:
                forest.join(r, k)
        index = sorted(np.flatnonzero(side < 2).tolist(), key=lambda i: (sizes[i], rid[i]))
        lists, names, held = Lists([sets[i] for i in index]), rid[index].tolist(), sizes[index]
        for q in np.flatnonzero(side != 1).tolist():
            a, n = int(rid[q]), int(sizes[q])
            same = lambda place: forest.find(names[place]) == forest.find(a)  # noqa: B023, E731
            if all(map(same, range(len(index)))):
                continue
            # the overlap from which sets of these sizes link; a set that has no such overlap needs more items than there are
            need = -(-percent * (n + held) // (100 + percent))
            for place in lists.divide_skip(sets[q], np.maximum(need, _overlap(n, percent)), same):
                forest.join(a, names[place])
        src, dst = forest.pairs()
        tidy()
        return pa.table([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return run


def _searched(members: DataFrame, spots: Column, chunks: DataFrame, words: int, percent: int) -> DataFrame:
    """src, dst: forests of the links in all groups.

    members: rid, chunk, known and places, one row for each rid; spots makes of a place `p` (which
    has a g) the lo, hi and side of the groups that the row is in.  The shingles of members are
    taken from their chunk anew, so they move only to their groups.
    """
    kind = members.schema["places"].dataType
    schema = T.StructType([*(T.StructField(x, T.LongType()) for x in ("rid", "known", "n")), T.StructField("items", T.BinaryType()), T.StructField("places", kind)])

    def give(chunk: Chunk, asked: pa.Table) -> pa.Table:
        at = asked.column("rid").to_numpy() - chunk.row
        size = chunk.first[at + 1] - chunk.first[at]
        s, f = _distinct(chunk.hash[spread(chunk.first[at], size)], np.concatenate([[0], np.cumsum(size)]), words)
        items = pa.array([s[a:z].tobytes() for a, z in zip(f[:-1], f[1:], strict=True)], pa.binary())
        return pa.table([asked.column("rid"), asked.column("known"), pa.array(np.diff(f), pa.int64()), items, asked.column("places")], names=schema.names)

    got = with_chunk(chunks, members, give, schema)
    placed = got.select("rid", "known", "n", "items", F.explode("places").alias("p"))
    full = placed.select("rid", "known", "n", "items", "p.g", F.explode(spots).alias("s")).select("rid", "known", "n", "items", "g", "s.*")
    return cut(full.groupBy("g", "lo", "hi").applyInArrow(_search(percent), "src bigint, dst bigint"))


def _links(reps: DataFrame, chunks: DataFrame, words: int, percent: int) -> DataFrame:
    """src, dst: edges that connect what links connect; reps: rid, chunk, prefix."""
    rare = reps.select("rid", F.explode("prefix").alias("x"))
    least = rare.groupBy("x").agg(F.min("rid").alias("m"), F.count("*").alias("c")).where("c > 1")
    blocks = components(rare.join(least, "x").select(F.col("rid").alias("src"), F.col("m").alias("dst")))
    sizes = blocks.groupBy("component").agg(F.count("*").alias("b"))
    placed = cut(blocks.join(sizes, "component").select(F.col("node").alias("rid"), "component", "b").join(reps.select("rid", "chunk"), "rid"))

    # a block of few rows is one group; a large one has tiles, and some rows of it are in all its tiles
    tiles = F.when(F.col("b") > TILE, F.ceil(F.col("b") / TILE)).otherwise(F.lit(1))
    pivot = (F.col("b") > TILE) & (F.pmod(F.xxhash64("rid", F.lit(1)), "b") < PIVOTS)
    place = F.struct(F.col("component").alias("g"), tiles.alias("tiles"), F.pmod(F.xxhash64("rid"), tiles).alias("mine"), pivot.alias("pivot"))
    none = F.lit(None).cast("long")
    first = placed.select("rid", "chunk", none.alias("known"), F.array(place).alias("places"))
    spot = "named_struct('lo', cast({} as bigint), 'hi', cast({} as bigint), 'side', {})"
    found = _searched(first, F.expr(f"transform(CASE WHEN p.pivot THEN sequence(0L, p.tiles - 1) ELSE array(p.mine) END, v -> {spot.format('v', 0, 0)})"), chunks, words, percent)
    large = placed.where(F.col("b") > TILE)
    if large.isEmpty():
        return found

    # what is left are pairs of different components that share a rare shingle
    known = components(found).select(F.col("node").alias("rid"), F.col("component").alias("known"))
    held = cut(rare.join(large.join(known, "rid", "left").select("rid", "chunk", F.coalesce("known", "rid").alias("known")), "rid"))
    signs = [F.bit_xor(F.xxhash64("rid", F.lit(i))).alias(f"s{i}") for i in range(2)]
    parts = held.groupBy("x", "known").agg(F.count("*").alias("c"), *signs)
    holders = parts.groupBy("x").agg(F.max_by("known", F.struct("c", "known")).alias("main"), F.max("c").alias("mains"), F.sum("c").alias("all"), F.count("*").alias("parts"), F.bit_xor("s0").alias("s0"), F.bit_xor("s1").alias("s1"))
    # shingles with the same holders ask for the same pairs
    once = holders.where("parts > 1").groupBy("s0", "s1", "all").agg(F.min_by(F.struct("x", "main", "mains"), "x").alias("h"))
    groups = cut(once.select("h.x", "h.main", F.when(F.col("all") <= TILE, 0).otherwise(F.ceil(F.col("h.mains") / TILE)).alias("t"), F.ceil((F.col("all") - F.col("h.mains")) / TILE).alias("u")))
    # the largest component of the holders has t tiles, the others u; pairs inside it are known
    place = F.struct(F.col("x").alias("g"), "t", "u", F.pmod(F.xxhash64("rid"), F.greatest("t", F.lit(1))).alias("a"), F.pmod(F.xxhash64("rid"), "u").alias("o"), (F.col("known") == F.col("main")).alias("main"))
    rest = held.join(groups, "x").groupBy("rid", "chunk", "known").agg(F.collect_list(place).alias("places"))
    spots = f"""CASE WHEN p.t = 0 THEN array({spot.format(0, 0, 0)})
        WHEN p.main THEN transform(sequence(0L, p.u - 1), v -> {spot.format("p.a", "v", 1)})
        ELSE concat(transform(sequence(0L, p.t - 1), v -> {spot.format("v", "p.o", 2)}),
                    transform(sequence(0L, p.u - 1), v -> {spot.format("p.t + least(p.o, v)", "greatest(p.o, v)", "CASE WHEN p.o = v THEN 0 WHEN p.o < v THEN 1 ELSE 2 END")})) END"""
    return found.union(_searched(rest, F.expr(spots), chunks, words, percent))


def near_sets(docs: DataFrame, key: str, text: str, words: int, percent: int, word_bytes: np.ndarray = SPACED) -> tuple[DataFrame, DataFrame]:
    """(rows, links): rid, key, n of every row; and the component's root rid of each linked row."""
    chunks = chunked(docs, key, text, word_bytes)
    n_total = chunks.agg(F.sum("n_words")).first()[0] or 0
    answers = totals(chunks, lambda h, first: _distinct(h, first, words)[0], n_total)

    def settle(chunk: Chunk, total: np.ndarray) -> pa.Table:
        s, f = _distinct(chunk.hash, chunk.first, words)
        df = total[np.unique(s, return_inverse=True)[1]]
        n = np.diff(f)
        row = np.repeat(np.arange(len(n)), n)
        shared = np.bincount(row, weights=df > 1, minlength=len(n)).astype(np.int64)
        alive = (n > 0) & (100 * shared >= percent * n)
        same, prefix = np.zeros((2, len(n)), dtype=np.int64), [None] * len(n)
        for i in np.flatnonzero(alive):
            x, d = s[f[i] : f[i + 1]], df[f[i] : f[i + 1]]
            same[:, i] = np.array([mix(x).sum(), np.bitwise_xor.reduce(mix(x + np.uint64(77)))]).view(np.int64)
            rare = np.lexsort((x, d))[: len(x) - _overlap(len(x), percent) + 1]
            prefix[i] = x[rare][d[rare] > 1].view(np.int64)
        gone = ~alive
        return pa.table(
            [
                pa.array(chunk.row + np.arange(len(n))),
                chunk.keys,
                pa.array(n),
                pa.array(same[0], mask=gone),
                pa.array(same[1], mask=gone),
                pa.array(np.full(len(n), chunk.id)),
                pa.array(prefix, pa.list_(pa.int64())),
            ],
            names=["rid", "k", "n", "same", "same2", "chunk", "prefix"],
        )

    schema = T.StructType(
        [
            T.StructField("rid", T.LongType()),
            T.StructField("k", docs.schema[key].dataType),
            T.StructField("n", T.LongType()),
            T.StructField("same", T.LongType()),
            T.StructField("same2", T.LongType()),
            T.StructField("chunk", T.LongType()),
            T.StructField("prefix", T.ArrayType(T.LongType())),
        ]
    )
    rows = cut(per_chunk(chunks, answers, settle, schema))
    alive = rows.where("same is not null")
    classes = cut(alive.groupBy("same", "same2", "n").agg(F.min("rid").alias("rep")))
    copies = alive.select("rid", "same", "same2", "n").join(classes, ["same", "same2", "n"]).where("rid <> rep").select(F.col("rid").alias("src"), F.col("rep").alias("dst"))

    reps = alive.join(classes.select(F.col("rep").alias("rid")), "rid", "left_semi").select("rid", "chunk", "prefix")
    return rows, components(_links(reps, chunks, words, percent).union(copies))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """key, n_shingles, component_id: one row for each row of docs.

    component_id is the smallest key reachable by links.  A null or empty text has no shingles
    and no links.  Rows with equal texts link, also where keys repeat; a null key takes part in
    links but is never a component_id (null if no row of the component has a key).  Texts are read
    whole, however long, an empty table gives no rows, and other columns are left out, whatever their names.
    """
    rows, links = near_sets(docs, key, text, words, percent)
    light = rows.select("rid", F.col("k").alias(key), F.col("n").alias("n_shingles"))
    linked = light.join(links.select(F.col("node").alias("rid"), F.col("component").alias("root")), "rid", "left")
    alone = linked.where("root is null").select(key, "n_shingles", F.col(key).alias("component_id"))
    group = linked.where("root is not null")
    smallest = group.groupBy("root").agg(F.min(key).alias("component_id"))
    return group.join(smallest, "root").select(key, "n_shingles", "component_id").union(alone)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: the one with the smallest key (of rows with that key, one text's).

    Rows without a key stay, and so do rows without words; of rows with the same key and text one
    stays.  Rows are told apart by key and text, so different texts under one key are judged each
    for itself.  Other columns are kept as they are; an empty table gives no rows.
    """
    name = F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("a"), F.xxhash64(text).alias("b")))
    links = cut(join(docs.select(name.alias("__id"), F.col(text).alias("__t")), "__id", "__t", words, percent).where("__id is not null"))
    drop = links.where("__id <> component_id").select(F.col("__id").alias("__gone")).distinct()
    twice = links.groupBy("__id").count().where("count > 1").select(F.col("__id").alias("__twice"))
    kept = docs.select(name.alias("__id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")).join(drop, F.col("__id") == F.col("__gone"), "left_anti")
    once = kept.join(twice, F.col("__id") == F.col("__twice"), "left_anti")
    again = kept.join(twice, F.col("__id") == F.col("__twice"), "left_semi").dropDuplicates(["__id"])
    return once.unionByName(again).select("__row.*")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, w[i : i + 3] AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
shared AS (SELECT s FROM sh GROUP BY 1 HAVING count(*) > 1),
live AS (SELECT doc_id, s FROM sh SEMI JOIN shared USING (s)),
fit AS (SELECT doc_id, n FROM (SELECT doc_id, count(*) AS k FROM live GROUP BY 1) JOIN sizes USING (doc_id) WHERE 100 * k >= 85 * n),
cand AS (SELECT live.* FROM live SEMI JOIN fit USING (doc_id)),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM cand a JOIN cand b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN fit na ON na.doc_id = a.doc_id JOIN fit nb ON nb.doc_id = b.doc_id
  GROUP BY 1, 2, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_ AS (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY 1)
SELECT words.doc_id, coalesce(n, 0) AS n_shingles, least(words.doc_id, coalesce(m, words.doc_id)) AS component_id
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN least_ USING (doc_id)
"""

QUERIES = {"op9_jaccard_join": op9_jaccard_join}
ORACLE_SQL = {"op9_jaccard_join": SQL}
