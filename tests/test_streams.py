"""Streams with state against their batch forms: rows in shuffled micro-batches, with a restart between them."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioscope.streaming import events as st
from folioscope.streaming import ordered


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before, parts = spark.conf.get(name), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(name, ordered.STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set(name, before)
    spark.conf.set("spark.sql.shuffle.partitions", parts)


def written(df, path, n, r):
    """Files of a stream: n of them in the order of arrival, the rows within each shuffled."""
    rows = sorted(df.collect(), key=lambda x: x.arrival)
    size = -(-len(rows) // n)
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        r.shuffle(part)
        df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)


def drained(spark, make, schema, path, tmp, runs):
    """All rows that a stream over the folder gives, started anew for each of the runs that fill it."""
    out = str(tmp / "out")
    for fill in runs:
        fill()
        stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp / "c")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
    return spark.read.parquet(out).collect()


SCHEMA = "doc_id string, job_id string, sequence long, arrival long, job_state string, kind string"


def test_gate_and_cursor(rocks, tmp_path):
    r = random.Random(1)
    rows = []
    for a in range(80):
        d = r.choice("abc")
        if r.random() < 0.3:
            rows.append((d, f"{d}{r.randint(0, 3)}", None, a, None, "result"))
        else:
            rows.append((d, f"{d}{r.randint(0, 3)}", r.randint(0, 60), a, r.choice(["running", "succeeded", "failed"]), "event"))
    df = rocks.createDataFrame(rows, SCHEMA)
    last, there, want = {}, set(), []
    for d, job, seq, a, state, kind in rows:
        if kind == "result":
            there.add((d, job))
        elif seq > last.get(d, -1) and (state != "succeeded" or (d, job) in there):
            last[d] = seq
            want.append((d, seq, a, state))
    path = str(tmp_path / "in")
    halves = [lambda: written(df.where("arrival < 50"), path, 2, r), lambda: written(df.where("arrival >= 50"), path, 1, r)]
    got = drained(rocks, lambda s: ordered.gated_stream(s.where("kind = 'event'"), s.where("kind = 'result'").select("doc_id", "job_id", "arrival")), SCHEMA, path, tmp_path, halves)
    assert sorted(map(tuple, got)) == sorted(want)
    # where all results are there beforehand, that is the batch form
    early = df.withColumn("arrival", F.when(F.col("kind") == "result", F.col("arrival") - 1000).otherwise(F.col("arrival")))
    batch = st.accepted(early.where("kind = 'event'"), early.where("kind = 'result'"))
    path2 = str(tmp_path / "in2")
    (tmp_path / "2").mkdir()
    got = drained(rocks, lambda s: ordered.gated_stream(s.where("kind = 'event'"), s.where("kind = 'result'").select("doc_id", "job_id", "arrival")), SCHEMA, path2, tmp_path / "2", [lambda: written(early, path2, 2, r)])
    assert sorted(map(tuple, got)) == sorted((x.doc_id, x.sequence, x.arrival, x.job_state) for x in batch.collect())


def test_numbers(rocks, tmp_path):
    r = random.Random(2)
    df = rocks.createDataFrame([(r.choice(["a", "b", None]), a) for a in range(60)], "doc_id string, arrival long")
    want = st.numbered(df.where("doc_id is not null"), rocks.createDataFrame([], "doc_id string, sequence long")).collect()
    path = str(tmp_path / "in")
    got = drained(rocks, ordered.numbered_stream, df.schema, path, tmp_path, [lambda: written(df.where("arrival < 30"), path, 2, r), lambda: written(df.where("arrival >= 30"), path, 1, r)])
    assert sorted((x.doc_id, x.arrival, x.sequence) for x in got if x.doc_id) == sorted((x.doc_id, x.arrival, x.sequence) for x in want)
    assert sorted(x.sequence for x in got if x.doc_id is None) == list(range(1, 1 + df.where("doc_id is null").count()))


def test_sessions(rocks, tmp_path):
    r = random.Random(3)
    start, rows, t = datetime(2024, 1, 1), [], 0
    for a in range(60):
        t += r.choice([5, 40, 299, 300, 301, 900])
        rows.append((r.choice("ab"), start + timedelta(seconds=t), a))
    rows.append(("end", start + timedelta(days=1), 60))
    df = rocks.createDataFrame(rows, "k string, ts timestamp, arrival long")
    want = [x for x in st.sessions(df, "k", "ts").collect() if x.k != "end"]
    path = str(tmp_path / "in")
    got = drained(rocks, lambda s: ordered.session_stream(s, "k", "ts", 300, "2 hours"), df.schema, path, tmp_path, [lambda: written(df.where("arrival < 40"), path, 2, r), lambda: written(df.where("arrival >= 40"), path, 2, r)])
    assert sorted((x.k, x.start, x.end, x.n) for x in got) == sorted((x.k, x.start, x.end, x.n) for x in want)


def test_reconciling_ends_when_states_agree(rocks, tmp_path):
    schema = "doc_id string, state string, arrival long, kind string"
    path, out = str(tmp_path / "in"), []
    put = lambda *rows: rocks.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(path)
    put(("a", "indexing", 1, "document"), ("a", "completed", 2, "job"), ("b", "completed", 3, "document"), ("b", "completed", 4, "job"), ("c", "queued", 5, "document"))
    s = rocks.readStream.schema(schema).parquet(path)
    told = ordered.reconcile_stream(s.where("kind = 'document'"), s.where("kind = 'job'"), 1)
    q = told.writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(60):
            if len(out) > 1 or q.awaitTermination(1):
                break
        put(("a", "completed", 9, "document"))
        for _ in range(30):  # until nothing is told for a while
            n = len(out)
            if q.awaitTermination(4) or len(out) == n:
                break
    finally:
        q.stop()
    assert {(x.doc_id, x.state, x.job_state) for x in out} == {("a", "indexing", "completed")}
    assert q.exception() is None and len(out) == n
    assert [x.asked for x in out] == list(range(1, len(out) + 1)) and len(out) >= 2
