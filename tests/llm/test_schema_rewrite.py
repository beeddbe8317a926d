"""The sort into files and the rewrite by field id against a brute-force version over the real files."""

import glob
import hashlib
import math
import os
import random
import zlib
from datetime import datetime, timedelta

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm import schema_rewrite

DIR = "/root/testdata/sf0.001"
NAMES = ["client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]
SCHEMA = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
START = datetime(1970, 1, 1)


def clients(n, seed=2, ids=None):
    r = random.Random(seed)
    out = []
    for i in range(n):
        some = lambda x: None if r.random() < 0.15 else x
        at = some(datetime(2024, 1, 1) + timedelta(microseconds=r.randrange(10**12)))
        out.append((ids(i) if ids else i, some(i // 2), some("crm|web"), at, some(f"Namé {i}"), some(f"a{i}@x.org"), some("C"), some(r.randrange(25)), some("retail"), some(round(r.uniform(-900, 9000), 2))))
    return out


def version_of(n):
    v = zlib.crc32(f"19:{n}".encode()) % 24
    return v if v <= 15 else 0


def expected(rows, files=250):
    """file_no -> all that the contract tells of a final file; rows of one key by their text."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, zlib.crc32(str(r[0]).encode()) if r[0] is not None else 0, r[0] or 0))
    size, out = 1 + len(rows) // files, {}
    for n in range(-(-len(rows) // size)):
        v, lines, ids, nulls = version_of(n), [], [], 0
        for r in rows[n * size : (n + 1) * size]:
            r = list(r)
            if v & 4:
                r[7], r[8] = -1, "none"
            if v & 8 and r[9] is not None:
                r[9] = float(np.float32(r[9]))
            nulls += sum(x is None for x in r)
            micros = None if r[3] is None else (r[3] - START) // timedelta(microseconds=1)
            shown = [*r[:3], micros, *r[4:9], None if r[9] is None else math.floor(1048576 * r[9])]
            ids.append("?" if r[0] is None else str(r[0]))
            lines.append("|".join("?" if x is None else str(x) for x in shown))
        start = list(NAMES)
        if v & 4:
            start = [x for x in start if x not in ("nation_id", "segment")]
        if v & 2:
            start = [start[0], *start[:0:-1]]
        if v & 1:
            start = [{"name": "email", "email": "name"}.get(x, x) for x in start]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[n] = (v, len(ids), nulls, sha(",".join(ids)), sha("\n".join(lines)), ",".join(start), ",".join(NAMES), v != 0)
    return out


def told(df):
    rows = df.collect()
    assert len({r.file_no for r in rows}) == len(rows)
    return {r.file_no: (r.version, r.n_rows, r.n_nulls, r.ids_sha256, r.rows_sha256, r.start_columns, r.columns, r.rewritten) for r in rows}, {r.file_no: r.path for r in rows}


def run(df, files=250):
    return schema_rewrite.sort_and_rewrite(df, "client_id", schema_rewrite.clients_drift(df), files)


def test_files_equal_brute_force(spark):
    rows = clients(700)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("__crc", F.lit("x")).withColumn("rows", F.lit(1))
    got, paths = told(run(df, 20))
    assert got == expected(rows, 20)
    folder = os.path.dirname(paths[0]).removeprefix("file://")
    assert {f"file://{p}" for p in glob.glob(f"{folder}/**/*.parquet", recursive=True)} == set(paths.values())
    for n, p in paths.items():
        fields = pq.read_schema(p.removeprefix("file://"))
        assert fields.names == NAMES and [f.metadata[b"PARQUET:field_id"] for f in fields] == [str(i).encode() for i in range(1, 11)]
        assert [str(fields.field(c).type) for c in ("nation_id", "balance")] == ["int64", "double"], n


def test_nulls_ties_repeats_and_empty_tables(spark):
    one = clients(1)[0]
    rows = [one] * 90 + clients(30, ids=lambda i: None if i < 4 else -i)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got, _ = told(run(df, 12))
    want = expected(rows, 12)
    # the order of rows of one key is the operator's: compare what doesn't depend on it
    assert {n: (*x[:4], *x[5:]) for n, x in got.items() if n} == {n: (*x[:4], *x[5:]) for n, x in want.items() if n}
    assert {n: x[4] for n, x in got.items() if n} == {n: x[4] for n, x in want.items() if n}
    assert got[0][1] == want[0][1] and run(df.limit(0)).count() == 0
    assert told(run(df.limit(1)))[0].keys() == {0}


def test_odd_numbers(spark):
    rows = [(i, None, None, None, None, None, None, None, None, x) for i, x in enumerate([float("nan"), float("inf"), 1e300, -0.5, 0.0])]
    got, _ = told(run(spark.createDataFrame(rows, SCHEMA), 1))
    assert got[0][1] == 5 and got[0][2] == 5 * 8


@pytest.mark.parametrize("ranked", [1, 7, 10_000])
def test_cut_keys_are_exact(spark, ranked):
    r = random.Random(ranked)
    keys = [(r.choice([-1, 0, 5, 2**32 - 1, r.randrange(2**32)]), r.choice([-(2**63), 0, 2**63 - 1]), r.choice([-1, 1]), i) for i in range(300)]
    runs = spark.createDataFrame(keys, "__crc long, __id long, __tie long, __row long")
    ranks = sorted(r.sample(range(300), 9))
    assert schema_rewrite.cut_keys(runs, ranks, 300, ranked) == [sorted(keys)[i] for i in ranks]


def test_merge_holds_chunks_that_overlap_only(spark, monkeypatch):
    """Slices keep each run sorted, and none goes across a cut."""
    rows = spark.range(0, 5000, 1, 5).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    folder = f"{schema_rewrite.checkpoint_dir(spark)}/test-{random.random()}"
    table = schema_rewrite.merge_sort(rows, "k", 8, folder)
    assert table.files == 8
    merged = schema_rewrite._merged(table.slices, {n: n for n in range(8)}, table.kind)
    parts = [[r.k for r in p] for p in merged.rdd.glom().collect()]
    order = sorted(range(5000), key=lambda k: (zlib.crc32(str(k).encode()), k))
    assert parts == [order[i : i + 626] for i in range(0, 5000, 626)]
    assert all(r.v == 3 * r.k for r in merged.collect())


def test_rewrite_follows_the_manifest(spark):
    """A second rewrite of an up-to-date folder touches nothing."""
    df = spark.createDataFrame(clients(60), SCHEMA)
    drifts = schema_rewrite.clients_drift(df)
    folder = f"{schema_rewrite.checkpoint_dir(spark)}/test-{random.random()}"
    table = schema_rewrite.merge_sort(df, "client_id", 6, folder)
    start = spark.createDataFrame(schema_rewrite.drift(table, drifts, folder), "file_no int, version int, path string")
    final = schema_rewrite.rewrite(spark, start, drifts, f"{folder}/table").withColumn("version", F.lit(0)).cache()
    local = "/" + folder.removeprefix("file:").lstrip("/")
    before = {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{local}/table/*.parquet")}
    again = schema_rewrite.rewrite(spark, final, drifts, f"{folder}/table")
    assert {r.path for r in again.collect()} == {f"file://{p}" for p in before} and not any(r.rewritten for r in again.collect())
    assert before == {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{local}/table/*.parquet")}


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_query_over_the_whole_table(spark):
    got, _ = told(schema_rewrite.op12_schema_rewrite(spark, DIR))
    table = spark.read.parquet(f"{DIR}/clients.parquet")
    assert isinstance(table.schema["updated_at"].dataType, T.TimestampNTZType)
    assert got == expected([tuple(r) for r in table.select(*NAMES).collect()])
