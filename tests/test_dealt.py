"""Fragments of large tables: what a task sorts is a share of the rows that doesn't grow with them."""

import os
import re

import pytest

from folioscope import plans
from folioscope.operators import retrieval as rt
from folioscope.sources import store

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["k14_fragment_groups", "k15_completed_fragments", "j02_chunks_of_hits"])
def test_partitions_follow_the_rows(spark, monkeypatch, name):
    query = plans.queries()[name]
    want = sorted(map(tuple, query(spark, DIR).collect()))
    monkeypatch.setattr(store, "ROWS", 100)
    out = query(spark, DIR)
    parts = -(-spark.read.parquet(f"{DIR}/lineitem.parquet").count() // 100)
    dealt = re.findall(r"Exchange hashpartitioning\(.*, (\d+)\), (\w+)", out._jdf.queryExecution().executedPlan().toString())
    assert dealt and set(dealt) == {(str(parts), "REPARTITION_BY_NUM")}
    assert sorted(map(tuple, out.collect())) == want


@pytest.mark.parametrize("parts", [None, 7])
def test_complete_fragments(spark, parts):
    groups = spark.createDataFrame([(1, 1, "a", "1", "g:x", 0.5), (2, 1, "a", "1", "g:x", 0.9), (2, 2, "b", "1", "k:5", 0.1), (3, 1, "b", "2", "k:5", 0.2), (4, 1, None, "1", "k:6", 0.3)], "q int, rank int, doc_id string, version string, group string, score double")
    chunks = spark.createDataFrame(
        [("a", "1", True, "x", 2, "c", 1, "t1", ["H1"]), ("a", "1", True, "x", 1, "d", 2, "t2", ["H2"]), ("a", "1", True, "x", 1, "b", 3, "t3", ["H3"]), ("a", "1", False, "x", 0, "a", 4, "gone", ["H"]), ("b", "1", True, None, None, "e", 5, "t5", ["H5"]), (None, "1", True, None, None, "f", 6, "t6", ["H6"])],
        "doc_id string, version string, active boolean, split_group string, split_index int, chunk_key string, k int, text string, heading_path array<string>",
    )
    got = {(r.q, r["rank"]): (r.doc_id, r.version, r.score, [x["key"] for x in r.chunks], r.heading_path) for r in rt.complete_fragments(groups, chunks, "q", "k", parts).collect()}
    assert got == {(1, 1): ("a", "1", 0.5, [3, 2, 1], ["H3"]), (2, 1): ("a", "1", 0.9, [3, 2, 1], ["H3"]), (2, 2): ("b", "1", 0.1, [5], ["H5"])}
