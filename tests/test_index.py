"""Tables with several writers, the persisted keyword index, dense search by blocks."""

import math
import os
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import keyword_index
from folioscope.operators import retrieval as rt
from folioscope.operators.keyword_index import KeywordIndex
from folioscope.sources.log import Conflict, Folder, PartitionedTable
from folioscope.sources.store import Store


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "bucket int, v int")


def values(table):
    df = table.read()
    return [] if df is None else sorted(r.v for r in df.select("v").collect())


def test_names_are_taken_once(spark, tmp_path):
    f = Folder(spark, str(tmp_path / "f"))
    assert f.names() == [] and f.create("a", "1") and not f.create("a", "2") and f.create("b", "")
    assert f.text("a") == "1" and f.names() == ["a", "b"]


def test_writers_of_other_partitions_are_carried_over(spark, tmp_path):
    t = PartitionedTable(spark, str(tmp_path / "t"))
    t.change([0, 1], lambda _: rows(spark, (0, 10), (1, 11)))
    base, calls = t.version(), []

    def slow(old):
        calls.append(old)
        t.change([1], lambda o: o.select(F.lit(1).alias("bucket"), (F.col("v") + 100).alias("v")))
        return old.select(F.lit(0).alias("bucket"), (F.col("v") + 1).alias("v"))

    t.change([0], slow)
    assert values(t) == [11, 111] and len(calls) == 1 and t.version() == base + 2
    assert sorted(r.v for r in t.read(version=base).collect()) == [10, 11]


def test_a_lost_race_is_run_again(spark, tmp_path):
    t = PartitionedTable(spark, str(tmp_path / "t"))
    t.change([0], lambda _: rows(spark, (0, 1)))
    seen = []

    def add(old):
        seen.append(old.first().v)
        if len(seen) == 1:
            t.change([0], lambda o: o.select(F.lit(0).alias("bucket"), (F.col("v") + 10).alias("v")))
        return old.select(F.lit(0).alias("bucket"), (F.col("v") + 1).alias("v"))

    t.change([0], add)
    assert seen == [1, 11] and values(t) == [12]
    with pytest.raises(Conflict):
        t.commit(1, t.write(rows(spark, (0, 5)), [0]))
    t.change([0], lambda o: o.limit(0).select(F.lit(0).alias("bucket"), "v"))
    assert values(t) == [] and t.folders() == {}


def test_two_writers_race(spark, tmp_path):
    t = PartitionedTable(spark, str(tmp_path / "t"))
    t.change([0], lambda _: rows(spark, (0, 0)))
    more = lambda n: lambda: [t.change([0], lambda o: o.select(F.lit(0).alias("bucket"), (F.col("v") + n).alias("v")), 50) for _ in range(2)]
    threads = [threading.Thread(target=more(n)) for n in (1, 100)]
    [x.start() for x in threads]
    [x.join(120) for x in threads]
    assert values(t) == [202]


def test_store_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    one = spark.createDataFrame([(1,)], "x int")
    assert s.read() is None and s.publish(one) == 1 and s.publish(one.unionByName(one), after=1) == 2
    with pytest.raises(Conflict):
        s.publish(one, after=1)
    assert s.read().count() == 2 and s.read(1).count() == 1 and s.publish(one) == 3


def documents(seed, n):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    return [(i, " ".join(r.choices(vocab, weights=[1 / (j + 1) for j in range(60)], k=r.randint(0, 40)))) for i in range(n)]


def search(index, asked, limit, **more):
    return sorted(((r["q"], r["rank"], r["id"], round(r["score"], 6)) for r in index.search(asked, "q", "text", limit, **more).collect()))


def plain(spark, texts, asked, limit):
    chunks = spark.createDataFrame(texts, "id int, text string")
    return sorted((r["q"], r["rank"], r["id"], round(r["score"], 6)) for r in rt.keyword_search(rt.postings(chunks, "id", "text"), asked, "id", "q", "text", limit).collect())


def test_index_equals_search_of_all_postings(spark, tmp_path):
    texts = dict(documents(1, 400)) | {900: None, 901: "", 902: "...", 903: "w59 w59 w59"}
    asked = spark.createDataFrame([(1, "w59 w3"), (2, "w0 w1 w2 w40"), (3, None), (4, "nowhere"), (5, "w58")], "q int, text string")
    index = KeywordIndex(spark, str(tmp_path / "i"), "id", buckets=4, blocks=8)
    assert index.search(asked, "q", "text", 5).count() == 0
    index.build(spark.createDataFrame(list(texts.items()), "id int, text string"), "text")
    for limit in (1, 30):
        want = plain(spark, list(texts.items()), asked, limit)
        assert search(index, asked, limit) == want and search(index, asked, limit, prune=False) == want
    opened, there = index.blocks_read(asked.where("q in (1, 5)"), "q", "text", 1)
    assert opened < there / 3

    # an upsert rewrites the buckets of its chunks and no other
    before = index.table.folders()
    new = {7: "w59 w59 w59 w59 fresh", 950: "fresh w59", 3: None, 5: ""}
    changed = index.upsert(spark.createDataFrame(list(new.items()), "id int, text string"), "text")
    after = index.table.folders()
    assert {b for b in after if before.get(b) != after[b]} == set(changed) and len(changed) < 4 or len(changed) <= 4
    assert all(before[b] == after[b] for b in before if b not in changed)
    texts |= new
    asked = asked.unionByName(spark.createDataFrame([(6, "fresh")], "q int, text string"))
    assert search(index, asked, 5) == plain(spark, list(texts.items()), asked, 5)
    index.remove(spark.createDataFrame([(7,), (12345,)], "id int"))
    assert search(index, asked, 5) == plain(spark, [(k, t) for k, t in texts.items() if k != 7], asked, 5)
    assert index.upsert(spark.createDataFrame([], "id int, text string"), "text") == []


def test_concurrent_upserts(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "i"), "id", buckets=1, blocks=4)
    index.build(spark.createDataFrame([(0, "base")], "id int, text string"), "text")
    put = lambda k: lambda: index.upsert(spark.createDataFrame([(k, f"word{k} base")], "id int, text string"), "text")
    threads = [threading.Thread(target=put(k)) for k in (1, 2, 3)]
    [x.start() for x in threads]
    [x.join(120) for x in threads]
    asked = spark.createDataFrame([(1, "base word1 word2 word3")], "q int, text string")
    assert {r["id"] for r in index.search(asked, "q", "text", 9).collect()} == {0, 1, 2, 3} and index.total() == 4


@pytest.mark.parametrize(("block", "tile", "parts"), [(10_000, 1 << 21, 3), (7, 16, 100)])
def test_dense_search_equals_brute_force(spark, monkeypatch, block, tile, parts):
    monkeypatch.setattr(rt, "QUERY_BLOCK", block)
    r = np.random.default_rng(3)
    vectors = [(i, r.normal(size=4).tolist()) for i in range(150)]
    vectors += [(200 + i, vectors[7][1]) for i in range(20)]  # ties
    vectors += [(300, None), (301, [0.0] * 4), (302, [1.0, None, 0.0, 0.0]), (303, [float("nan"), 1.0, 0.0, 0.0]), (304, [float("inf"), 1.0, 0.0, 0.0]), (305, [1.0, 2.0]), (306, []), (7, vectors[7][1])]
    v = spark.createDataFrame(vectors, "vec_id int, e array<double>").repartition(parts)
    q = v.where("vec_id % 5 = 0 or vec_id > 298").select(F.col("vec_id").cast("string").alias("q_id"), F.col("e").alias("qe"))
    unit = lambda x: None if not x or None in x or not all(map(math.isfinite, x)) or not any(x) else np.array(x) / np.linalg.norm(x)
    held, want = [(k, unit(x)) for k, x in vectors], []
    for k, x in held:
        if x is not None and (k % 5 == 0 or k > 298):
            found = sorted(((-round(float(x @ y), 9), i) for i, y in held if y is not None and len(y) == len(x)))[:6]
            want += [(str(k), rank, i, round(-s, 6)) for rank, (s, i) in enumerate(found, 1)]
    got = rt.dense_search(v, q, "vec_id", "e", "q_id", "qe", 6)
    assert sorted((x.q_id, x.rank, x.vec_id, round(x.score, 6)) for x in got.collect()) == sorted(want)
    assert rt.dense_search(v, q.limit(0), "vec_id", "e", "q_id", "qe", 6).count() == 0
    assert rt.dense_search(v.limit(0), q, "vec_id", "e", "q_id", "qe", 6).count() == 0
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_neighbours_join_members_by_key(spark):
    c = spark.createDataFrame([("d", "1", True, "text", i, None, f"c{i:02d}", i, 10, []) for i in range(30)], "doc_id string, version string, active boolean, kind string, order int, split_index int, chunk_key string, chunk_id int, tokens int, placeholder_ids array<string>")
    hits = c.select(F.col("chunk_id").alias("hit_id"), "doc_id", "version", F.array("chunk_id").alias("members"), F.lit(None).cast("int").alias("asset_order"), "placeholder_ids")
    near = rt.neighbours(hits, c, 30)
    got = {r.hit_id: (r.before, r.after) for r in near.collect()}
    assert got[5] == ([3, 4], [6]) and got[0] == ([], [1, 2, 3]) and len(got) == 30
    assert "array_contains(members" not in near._jdf.queryExecution().toString()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_indexed_query_equals_the_plain_one(spark):
    from folioscope import plans

    d, key = "/root/testdata/sf0.001", lambda r: (r["item_id"], r["rank"], r["doc_id"], r["score"])
    assert sorted(map(key, plans.queries()["k06_indexed_search"](spark, d).collect())) == sorted(map(key, plans.queries()["k06_keyword_search"](spark, d).collect()))


def test_an_indexed_search_makes_no_rows_of_pairs(spark, tmp_path):
    r, words = random.Random(9), [f"w{i}" for i in range(15)]
    chunks = spark.createDataFrame([(i, " ".join(r.choices(words, k=r.randint(1, 12)))) for i in range(200)], "id int, text string")
    asked = spark.createDataFrame([(q, " ".join(r.choices(words, k=4))) for q in range(6)], "q int, text string")
    index = KeywordIndex(spark, str(tmp_path / "i"), "id", buckets=2, blocks=3)
    index.build(chunks, "text")
    found = [index.search(asked, "q", "text", 9, total=200, prune=p) for p in (True, False)]
    assert all("Join" not in x._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0] for x in found)
    rows = [sorted((x.q, x["rank"], x.id, round(x.score, 6)) for x in f.collect()) for f in found]
    want = sorted((x.q, x["rank"], x.id, round(x.score, 6)) for x in rt.keyword_search(rt.postings(chunks, "id", "text"), asked, "id", "q", "text", 9).collect())
    assert rows[0] == rows[1] == want


@pytest.fixture
def short_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("kind", ["int", "string", "struct<a:int,b:string>"])
def test_parts_of_blocks(spark, tmp_path, monkeypatch, short_batches, kind):
    """Parts end within a block, also where one key has several rows, and an upsert makes them anew."""
    monkeypatch.setattr(keyword_index, "PART_CHUNKS", 4)
    monkeypatch.setattr(keyword_index, "PART_BYTES", 900)
    key = {"int": int, "string": str}.get(kind, lambda i: (i // 9, str(i)))
    texts = [*documents(5, 150), (150, "w59 " * 120), (3, "w3 w4 twice"), (3, None), (7, "w0 twice"), (151, None), (152, "...")]
    asked = spark.createDataFrame([(str(q), t) for q, (_, t) in enumerate(documents(6, 12))] + [("x", None), (None, "w59 twice"), ("y", "nowhere")], "q string, text string")
    table = lambda rows: spark.createDataFrame([(key(k), t) for k, t in rows], f"id {kind}, text string")
    hits = lambda df: sorted((str(r["q"]), r["rank"], r["id"], round(r["score"], 6)) for r in df.collect())
    want = lambda rows: hits(rt.keyword_search(rt.postings(table(rows), "id", "text"), asked, "id", "q", "text", 7))
    index = KeywordIndex(spark, str(tmp_path / "i"), "id", buckets=2, blocks=3)
    index.build(table(texts).repartition(3), "text")
    read = index.table.read()
    assert read.where("term IS NULL AND n > 4").count() == 0 and read.agg(F.max("part")).first()[0] > 3
    assert index.total() == len({k for k, t in texts if t and "w" in t})
    assert hits(index.search(asked, "q", "text", 7)) == hits(index.search(asked, "q", "text", 7, prune=False)) == want(texts)
    index.upsert(table([(3, "w5 w5"), (20, None), (999, "twice w59")]), "text")
    texts = [(k, t) for k, t in texts if k not in (3, 20)] + [(3, "w5 w5"), (999, "twice w59")]
    assert hits(index.search(asked, "q", "text", 7)) == want(texts)


def test_queries_in_several_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rt, "QUERY_BLOCK", 2)
    texts = documents(8, 60)
    asked = spark.createDataFrame([(q, t) for q, (_, t) in enumerate(documents(9, 5))], "q int, text string")
    index = KeywordIndex(spark, str(tmp_path / "i"), "id", buckets=2, blocks=2)
    index.build(spark.createDataFrame(texts, "id int, text string"), "text")
    assert search(index, asked, 4) == plain(spark, texts, asked, 4)


def test_a_build_shuffles_texts_only(spark, tmp_path, monkeypatch):
    """No row for each posting, neither where parts are made nor where they are searched."""
    plans, write = [], PartitionedTable.write
    monkeypatch.setattr(PartitionedTable, "write", lambda self, rows, some: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), write(self, rows, some))[1])
    index = KeywordIndex(spark, str(tmp_path / "i"), "id", buckets=2, blocks=2)
    index.build(spark.createDataFrame(documents(2, 50), "id int, text string"), "text")
    found = index.search(spark.createDataFrame([(1, "w1 w2")], "q int, text string"), "q", "text", 3)
    assert len(plans) == 1 and "Generate" not in plans[0] and "Aggregate" not in plans[0] and plans[0].count("Repartition") == 1
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
