"""Ranked search against brute force: ties, repeated rows, nulls, many shards and blocks, and against its SQL."""

import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import ranked_search

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
DIR = "/root/testdata/sf0.001"


def terms(text):
    return TERM.findall((text or "").encode().translate(LOW))


def brute(docs, queries, k=10):
    """(item, rank, doc, score) by scoring every document for every query."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, bag, sum(bag.values())) for d, bag in bags if bag]
    n, total = len(bags), sum(b[2] for b in bags)
    df = Counter(t for _, bag, _ in bags for t in bag)
    out = []
    for item, text in queries:
        asked = [(t, math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))) for t in set(terms(text)) if df[t]]
        found = []
        for d, bag, size in bags:
            m = 100 - 90 + (90 * size * n) // total
            score = sum(w * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m)) for t, w in asked if bag[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(found)[:k], 1)]
    return out


def rows(df, *names):
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def corpus(seed, n):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["été", "日本", "A1", "x"]
    docs = [(i * 3 % 1009, " ".join(r.choices(vocab, weights=[1 / (j + 1) for j in range(len(vocab))], k=r.randint(0, 30)))) for i in range(n)]
    same = [(2000 + i, "w1 w2 w39 copies of one text") for i in range(60)]  # ties beyond k
    odd = [(5000, None), (5001, ""), (5002, "-- ++"), (None, "w1 w39 w38"), (None, "w1 w39 w38"), (-7, "w39"), docs[3], docs[3], (5003, "w0 " * 3000)]
    queries = [(1, "w1 w39"), (2, "W1 w2, w1 copies été"), (2, "w0"), (3, None), (4, "!!"), (5, "nowhere"), (None, "x A1 a1"), (1, "w1 w39"), (9, " ".join(vocab))]
    return docs + same + odd, queries


@pytest.mark.parametrize(("shard", "block"), [(1 << 20, 1 << 20), (700, 1 << 20), (700, 60), (1, 200)])
def test_equals_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", block)
    docs, queries = corpus(11, 300 if shard > 1 else 60)
    d = spark.createDataFrame([(*x, 1, "t") for x in docs], "doc_id long, text string, score int, k string").repartition(3)
    q = spark.createDataFrame([(*x, 1, 2) for x in queries], "item_id long, text string, rank int, doc_id int").repartition(2)

    # workers don't see the patched size: the shards are made here, as the task makes them
    if shard != 1 << 20:
        monkeypatch.setattr(ranked_search, "shards_of", _small_shards(shard))
    got = ranked_search.search(ranked_search.build(d), q)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(got, *got.columns) == sorted(brute(docs, queries), key=repr)


def _small_shards(size):
    def shards_of(batches, docs, total):
        from folioscope.llm import ranked_search as own
        from folioscope.llm.words import pieces

        for piece in pieces(batches, "t", size):
            if shard := own.shard_of(piece.column(0), piece.column(1), docs, total):
                yield shard

    return shards_of


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asks = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(ranked_search.build(none), asks).count() == 0
    assert ranked_search.search(ranked_search.build(some), asks.limit(0)).count() == 0
    assert ranked_search.search(ranked_search.build(spark.createDataFrame([(1, None)], "doc_id long, text string")), asks).count() == 0
    # the weight of a term that all documents hold is floor(1000 ln(4/3)) here, and 0 in a large corpus
    assert rows(ranked_search.search(ranked_search.build(some), asks), "doc_id", "rank") == [(1, 1)]


def test_terms_and_wavelet_levels():
    texts = ["a b", None, "", "ab", "É é-9_Z", "\x7fq"]
    got, first = ranked_search.terms_of(pa.array(texts))
    assert [[t.encode() for t in got.slice(a, b - a).to_pylist()] for a, b in zip(first[:-1], first[1:], strict=True)] == [terms(t) for t in texts]
    r = np.random.default_rng(1)
    sequence = r.integers(0, 100, 500)
    bits, order = ranked_search.levels_of(sequence, 7), sequence
    for k, b in zip(range(6, -1, -1), bits, strict=True):
        assert (((order >> k) & 1) == b).all()
        order = np.concatenate([order[~b], order[b]])
    key = [int(f"{v:07b}"[::-1], 2) for v in sequence]
    assert order.tolist() == [v for _, v in sorted(zip(key, sequence.tolist(), strict=True), key=lambda x: x[0])]


def test_later_shards_are_cut_by_earlier_ones():
    ids, texts = pa.array(range(400)), pa.array([f"a b c{i % 7}" + " z" * (i % 50) for i in range(400)])
    shard = ranked_search.shard_of(ids, texts, 400, 12_000)
    asked = pa.array(["a", "z"], pa.large_string())
    own = ranked_search.Shard({**shard, "terms": shard["terms"].cast(pa.large_string()), "doc_ids": shard["doc_ids"].to_pylist(), "levels": [x.as_buffer() for x in shard["levels"]]}, asked)
    opened = []
    inner = own._open
    own._open = lambda level, nodes, *rest: (opened.append(len(nodes)), inner(level, nodes, *rest))[1]
    own.search(np.array([0, 1]), np.array([5, 700]), 3, first := [])
    before, opened[:] = sum(opened), []
    assert len(first) == 3 and before < 400
    own.search(np.array([0, 1]), np.array([5, 700]), 3, [(10**12, -1, -1)] * 3)
    assert sum(opened) <= 1 < before


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_equals_sql(spark):
    got = ranked_search.op11_ranked_search(spark, DIR)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(f"SELECT item_id, rank, doc_id, score FROM ({ranked_search.SQL})").fetchall()
    assert rows(got, "item_id", "rank", "doc_id", "score") == sorted(want, key=repr)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    queries = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    assert sorted(want, key=repr) == sorted(brute(docs, queries), key=repr)
