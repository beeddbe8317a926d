"""Embedding near-dedup: pairs of vectors whose cosine reaches a threshold, by spherical-cap filters.

A filter is a direction; a vector belongs to it if its inner product with it reaches `alpha`
(or nearly that of its best direction).  Two similar vectors share some filter with high probability.  The directions form random product
codes: a rotated vector is cut into blocks, each block has a small random code, and a direction
is one code word of each block.  So a vector's filters are list-decoded block by block: partial
sums that can no longer reach `alpha` are cut off, and all directions beyond it are found without
looking at the others.  Vectors are joined on filters and verified by their exact cosine.

Equal vectors collapse before the join.  A filter with very many vectors is cut into tiles, and
each pair of tiles is a group of its own.  A pair that shares several filters is counted in the
first of them: each row carries the numbers of its vector's earlier filters, four bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, exp, lgamma, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import cut
from .graph import Forest, components
from .words import tidy

THRESHOLD = 0.9
#: Independent product codes at least; filters that a vector would have in each by alpha alone, on average, and
#: unrelated vectors that a filter would then hold.  Large filters are few: fewer rows go through the shuffle, and
#: what they hold is compared by one matrix product.
CODES, FILTERS, UNRELATED = 4, 2, 32
#: Expected share of the pairs at exactly the threshold that share a filter, whatever n is.
RECALL = 0.995
#: Random pairs from which a code's share of lost pairs is estimated, and codes that filter ids have room for.
PAIRS, MOST_CODES = 4000, 256
#: The least components of a block, the most words of its code, and the greatest inner product that a filter asks for.
NARROW, MOST_WORDS, CLOSEST = 4, 4096, 0.95
#: A vector also takes the directions that fall short of its best one by this at most, in standard deviations of
#: an inner product (1 / sqrt(dim)), and in many or few dimensions never more than the second.
SLACK, WIDEST = 0.12, 0.015
#: Vectors of a tile.
TILE = 1024
#: Filters of a matrix that tells which members share one.
SLAB = 4096
#: Members up to which groups are verified many at a time.
SMALL = 16
#: Heavy filters that the driver may tell all tasks of (others are joined).
HEAVY = 100_000


def cap(dim: int, t: float) -> float:
    """Share of the unit sphere with an inner product of at least t with a fixed direction."""
    if dim < 3:
        return acos(t) / pi if dim == 2 else 0.5
    c = exp(lgamma(dim / 2) - lgamma((dim - 1) / 2)) / sqrt(pi)
    x = np.linspace(t, 1, 4001)
    y = np.maximum(1 - x * x, 0) ** ((dim - 3) / 2)
    return float(c * ((y[1:] + y[:-1]) / 2).sum() * (x[1] - x[0]))


class Code:
    """One rotated random product code over vectors of one dimension."""

    def __init__(self, dim: int, n: int, seed: int) -> None:
        rng = np.random.Generator(np.random.PCG64([seed, dim]))
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        # a filter holds as many vectors of an unrelated kind whatever n is
        words = max(2.0, FILTERS * max(n, 2) / UNRELATED)
        blocks = min(max(1, dim // NARROW), max(2, ceil(log(words) / log(96))))
        # smaller caps than pairs are near would part pairs without sparing any: in few dimensions that bounds the filters
        words = max(2.0, min(words, FILTERS / max(cap(dim, CLOSEST), 1e-300), float(MOST_WORDS) ** blocks))
        self.size = max(2, ceil(words ** (1 / blocks)))
        ends = np.linspace(0, dim, blocks + 1).astype(int)
        self.parts = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            x = rng.standard_normal((self.size, b - a))
            self.parts.append((a, b, x / np.linalg.norm(x, axis=1, keepdims=True) * sqrt((b - a) / dim)))
        self.words = self.size**blocks
        self.slack = min(WIDEST, SLACK / sqrt(dim))
        share, lo, hi = FILTERS / float(self.size) ** blocks, 0.0, 1.0
        for _ in range(40):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if cap(dim, mid) > share else (lo, mid)
        self.alpha = lo

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all directions that reach alpha; x: unit vectors."""
        y = x @ self.rotation
        dots = [y[:, a:b] @ c.T for a, b, c in self.parts]
        best = np.cumsum([d.max(axis=1) for d in dots][::-1], axis=0)[::-1]  # the most that blocks i.. can add
        # a vector between the directions takes those near its best, so none is left out
        reach = np.minimum(self.alpha, best[0] - self.slack)
        row, code, total = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        for i, d in enumerate(dots):
            rest = best[i + 1] if i + 1 < len(dots) else np.zeros(len(x))
            need = reach[row] - rest[row] - total
            r, c = np.nonzero(d[row] >= need[:, None])
            code = code[r] * self.size + c
            total = total[r] + d[row[r], c]
            row = row[r]
        return row, code


def pairs_at(dim: int, cosine: float, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n random pairs of unit vectors with that cosine."""
    rng = np.random.Generator(np.random.PCG64([seed, dim]))
    x, z = rng.standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return x, cosine * x + sqrt(1 - cosine * cosine) * z


def meets(code: Code, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of rows share a filter of the code."""
    out = np.zeros(len(x), dtype=bool)
    for at in range(0, len(x), 250):
        both = [np.rec.fromarrays(code.decode(v[at : at + 250])) for v in (x, y)]
        out[at + np.intersect1d(*both)["f0"]] = True
    return out


def codes_needed(dim: int, n: int, threshold: float) -> int:
    """Codes at which pairs at exactly the threshold share a filter with a probability of RECALL.

    The rotations are independent, so a pair is lost by all codes with the product of the
    probabilities of each.
    """
    if dim < 3 or threshold >= 1:
        return CODES
    x, y = pairs_at(dim, threshold, PAIRS // 2, 1 << 20)
    lost = 1 - np.mean([meets(Code(dim, n, seed), x, y).mean() for seed in (1 << 20, (1 << 20) + 1)])
    # with none lost in the sample, no more than one in PAIRS is taken to be
    need = ceil(log(1 - RECALL) / log(max(lost, 1 / PAIRS))) if lost < 1 else MOST_CODES + 1
    if need > MOST_CODES:
        raise ValueError(f"a recall of {RECALL} at cosine {threshold} takes more than {MOST_CODES} codes")
    return max(CODES, need)


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _spanning(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Pairs that connect what the matrix connects: each member and the least one that it reaches."""
    far = max(int(a.max()), int(b.max())) + 1
    left, right = a.copy(), np.full(len(b), far)
    while True:
        right_new = np.minimum(right, np.where(near, left[:, None], far).min(axis=0))
        left_new = np.minimum(left, np.where(near, right_new[None, :], far).min(axis=1))
        if (right_new == right).all() and (left_new == left).all():
            break
        left, right = left_new, right_new
    on_a, on_b = near.any(axis=1), right < far
    return [*a[on_a].tolist(), *b[on_b].tolist()], [*left[on_a].tolist(), *right[on_b].tolist()]


def _groups(table: pa.Table) -> np.ndarray:
    """Where groups begin in a table sorted by group."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for c in ("dim", "fid", "lo", "hi"):
        v = table.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _usable(x: list | None) -> bool:
    if not x or any(v is None for v in x):
        return False
    a = np.asarray(x, dtype=np.float64)
    with np.errstate(over="ignore"):
        norm = np.linalg.norm(a)
    return bool(np.isfinite(a).all() and norm > 0 and np.isfinite(norm))


def links(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """key, n_links, component_id, kept: one row for each row of vectors.

    Null, empty and zero vectors and those with null or non-finite components link with nothing,
    nor do vectors of different lengths.  Equal vectors link, also where keys repeat; a null key
    takes part in links but is never a component_id.
    """
    spark = vectors.sparkSession
    kind = "<f4" if isinstance(vectors.schema[vector].dataType.elementType, T.FloatType) else "<f8"
    source = vectors.select(F.col(key).alias("k"), F.col(vector).alias("x"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = TaskContext.get().partitionId() << 40
        for batch in batches:
            raw = [np.asarray(x, dtype=kind).tobytes() if _usable(x) else None for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(done, done + len(raw))), batch.column(0), pa.array(raw, pa.binary())], names=["rid", "k", "v"])
            done += len(raw)

    rows = cut(source.mapInArrow(number, T.StructType([T.StructField("rid", T.LongType()), T.StructField("k", source.schema["k"].dataType), T.StructField("v", T.BinaryType())])))
    classes = cut(rows.where("v is not null").groupBy("v").agg(F.min("rid").alias("rep"), F.count("*").alias("w")))
    width = np.dtype(kind).itemsize
    by_dim = {r[0] // width: r[1] for r in classes.groupBy(F.length("v")).count().collect()}
    n = sum(by_dim.values())
    needed = {dim: codes_needed(dim, n, threshold) for dim in by_dim}
    # filters of all codes of a dimension in one numbering, as narrow as it can be
    number_type = {dim: "<u4" if needed[dim] * Code(dim, n, 0).words <= 1 << 32 else "<i8" for dim in by_dim}
    codes: dict[int, list[Code]] = {}

    def code(dim: int) -> list[Code]:
        if dim not in codes:
            codes[dim] = [Code(dim, n, seed) for seed in range(needed[dim])]
        return codes[dim]

    def filters(heavy: dict[tuple[int, int], int] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    batch = whole.slice(at, 1000)
                    raw = batch.column(0).to_pylist()
                    for size in sorted({len(r) for r in raw}):
                        of = [i for i, r in enumerate(raw) if len(r) == size]
                        x = _unit([raw[i] for i in of], kind)
                        dim = x.shape[1]
                        found = [c.decode(x) for c in code(dim)]
                        row = np.concatenate([f[0] for f in found])
                        fid = np.concatenate([f[1] + s * c.words for s, (f, c) in enumerate(zip(found, code(dim), strict=True))])
                        order = np.lexsort((fid, row))
                        row, fid = row[order], fid[order]
                        if heavy is None:
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fid), dim)), pa.array(fid)], names=["dim", "fid"])
                            continue
                        rep, w = batch.column(1).to_numpy()[of], batch.column(2).to_numpy()[of]
                        first = np.searchsorted(row, np.arange(len(of)))
                        numbers, width = fid.astype(number_type[dim]).tobytes(), np.dtype(number_type[dim]).itemsize
                        out, earlier = [], []
                        for i, (r, f) in enumerate(zip(row.tolist(), fid.tolist(), strict=True)):
                            tiles = heavy.get((dim, f), 1)
                            mine = int(rep[r]) * 0x9E3779B97F4A7C15 % (1 << 64) % tiles if tiles > 1 else 0
                            out += [(r, f, mine, min(mine, o), max(mine, o)) for o in range(tiles)]
                            earlier += [numbers[first[r] * width : i * width]] * tiles
                        if out:
                            r, f, mine, lo, hi = map(np.array, zip(*out, strict=True))
                            columns = [pa.array(np.full(len(r), dim)), *map(pa.array, (f, lo, hi, mine, rep[r], w[r])), pa.array([raw[of[i]] for i in r], pa.binary()), pa.array(earlier, pa.binary())]
                            yield pa.RecordBatch.from_arrays(columns, names=MEMBER)

        return run

    def met_before(table: pa.Table, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which rows of a share an earlier filter with which of b; filters are looked at some thousand at a time."""
        kind_of = number_type[table.column("dim")[0].as_py()]
        lists = [np.frombuffer(f.as_py(), dtype=kind_of) for f in table.column("earlier")]
        owner, ids = np.repeat(np.arange(len(lists)), [len(f) for f in lists]), np.concatenate(lists)
        place = np.unique(ids, return_inverse=True)[1]
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        met = np.zeros((len(a), len(b)), dtype=bool)
        for at in range(0, int(place[-1]) + 1 if len(place) else 0, SLAB):
            i, j = np.searchsorted(place, (at, at + SLAB))
            has = np.zeros((len(lists), SLAB), dtype=np.float32)
            has[owner[i:j], place[i:j] - at] = 1
            met |= has[a] @ has[b].T > 0
        return met

    def verify(table: pa.Table) -> pa.Table:
        rep, w, mine = (table.column(c).to_numpy() for c in ("rep", "w", "tile"))
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        x = _unit(table.column("v").to_pylist(), kind)
        a = np.flatnonzero(mine == lo)
        b = a if lo == hi else np.flatnonzero(mine == hi)
        near = x[a] @ x[b].T >= threshold
        if lo == hi:
            np.fill_diagonal(near, False)
        forest, count = Forest(), np.zeros(len(rep), dtype=np.int64)
        i, j = np.nonzero(near)
        if len(i):
            # only rows with something near need their lists
            on_a, on_b = np.unique(i), np.unique(j)
            some, at = np.unique(np.concatenate([a[on_a], b[on_b]]), return_inverse=True)
            new = near.copy()
            new[np.ix_(on_a, on_b)] &= ~met_before(table.take(pa.array(some)), at[: len(on_a)], at[len(on_a) :])
            count[a] += new @ w[b]
            if lo != hi:
                count[b] += w[a] @ new
            for p, q in zip(*_spanning(near, a, b), strict=True):
                forest.join(int(rep[p]), int(rep[q]))
        has_any = np.flatnonzero([int(r) in forest.parent for r in rep])
        return pa.table([pa.array(rep[has_any]), pa.array(count[has_any]), pa.array([forest.find(int(r)) for r in rep[has_any]], pa.int64())], names=["rep", "n", "root"])

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of rows sorted by group: those of up to SMALL members together, larger ones by matrix."""
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None and held.num_rows else table
            if held.num_rows >= 20_000:
                done = _groups(held)[-1]
                if done:
                    yield from work(held.slice(0, done))
                held = held.slice(done)
        if held is not None and held.num_rows:
            yield from work(held)
        tidy()

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        at = np.concatenate([_groups(table), [table.num_rows]])
        size = np.diff(at)
        whole = table.column("lo").to_numpy() == table.column("hi").to_numpy()
        for g in np.flatnonzero((size > SMALL) | ((size > 1) & ~whole[at[:-1]])).tolist():
            yield from verify(table.slice(at[g], size[g])).to_batches()
        small = np.repeat((size > 1) & (size <= SMALL) & whole[at[:-1]], size)
        table, group = table.filter(pa.array(small)), np.repeat(np.arange(len(size)), size)[small]
        for dim in np.unique(table.column("dim").to_numpy()).tolist():
            of = table.column("dim").to_numpy() == dim
            rows, mine = table.filter(pa.array(of)), group[of]
            x = _unit(rows.column("v").to_pylist(), kind)
            rep, w, earlier = rows.column("rep").to_numpy(), rows.column("w").to_numpy(), rows.column("earlier")
            forest, count = Forest(), np.zeros(len(rep), dtype=np.int64)
            for k in range(1, SMALL):
                i = np.flatnonzero(mine[:-k] == mine[k:])
                if not len(i):
                    break
                for i in i[np.einsum("ij,ij->i", x[i], x[i + k]) >= threshold].tolist():
                    j = i + k
                    forest.join(int(rep[i]), int(rep[j]))
                    if not len(np.intersect1d(*(np.frombuffer(earlier[p].as_py(), dtype=number_type[dim]) for p in (i, j)))):
                        count[i] += w[j]
                        count[j] += w[i]
            hit = np.flatnonzero([int(r) in forest.parent for r in rep])
            yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(count[hit]), pa.array([forest.find(int(r)) for r in rep[hit]], pa.int64())], names=["rep", "n", "root"])

    sizes = classes.select("v", "rep", "w").mapInArrow(filters(None), "dim bigint, fid bigint").groupBy("dim", "fid").count().where(F.col("count") > TILE)
    heavy = cut(sizes.select("dim", "fid", F.ceil(F.col("count") / TILE).alias("tiles")))
    schema = "dim bigint, fid bigint, lo bigint, hi bigint, tile bigint, rep bigint, w bigint, v binary, earlier binary"
    known = {(r[0], r[1]): r[2] for r in heavy.collect()} if heavy.count() <= HEAVY else {}
    members = classes.select("v", "rep", "w").mapInArrow(filters(known), schema)
    if heavy.count() > HEAVY:
        tile = F.pmod(F.xxhash64("rep"), F.coalesce("tiles", F.lit(1)))
        members = members.drop("lo", "hi", "tile").join(heavy, ["dim", "fid"], "left").withColumn("tile", tile)
        members = members.withColumn("o", F.explode(F.expr("sequence(0L, coalesce(tiles, 1L) - 1)")))
        members = members.select("dim", "fid", F.least("tile", "o").alias("lo"), F.greatest("tile", "o").alias("hi"), "tile", "rep", "w", "v", "earlier")
    group = ["dim", "fid", "lo", "hi"]
    dealt = members.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *group).sortWithinPartitions(*group)
    found = cut(dealt.mapInArrow(in_order, "rep bigint, n bigint, root bigint"))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    of_class = classes.select("v", "rep", "w").join(counts, "rep", "left").join(roots.select(F.col("node").alias("rep"), F.col("component").alias("root")), "rep", "left")
    each = rows.join(of_class.select("v", F.coalesce("root", "rep").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links")), "v", "left").select("rid", "k", "n_links", F.coalesce("root", "rid").alias("root"))
    alone = each.where("coalesce(n_links, 0) = 0").select("k", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"))
    group = each.where("n_links > 0")
    smallest = group.groupBy("root").agg(F.min("k").alias("component_id"))
    out = group.join(smallest, "root").select("k", "n_links", "component_id").union(alone)
    return out.select(F.col("k").alias(key), "n_links", "component_id", F.col("k").eqNullSafe(F.col("component_id")).alias("kept"))


MEMBER = ["dim", "fid", "lo", "hi", "tile", "rep", "w", "v", "earlier"]


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_ AS (SELECT x AS vec_id, min(y) AS m FROM reach GROUP BY 1),
n AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT v.vec_id, coalesce(n, 0) AS n_links, least(v.vec_id, coalesce(m, v.vec_id)) AS component_id,
       v.vec_id = least(v.vec_id, coalesce(m, v.vec_id)) AS kept
FROM v LEFT JOIN n USING (vec_id) LEFT JOIN least_ USING (vec_id)
"""

QUERIES = {"op8_embedding_dedup": op8_embedding_dedup}
ORACLE_SQL = {"op8_embedding_dedup": SQL}
