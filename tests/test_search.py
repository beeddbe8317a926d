"""The whole search on a small table, worked out by hand, and its bounds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import evaluation as ev
from folioscope.operators import retrieval as rt
from folioscope.operators import search

SCHEMA = "chunk_id int, doc_id string, version string, name string, label string, active boolean, kind string, order int, split_group string, split_index int, chunk_key string, text string, heading_path array<string>, tokens int, placeholder_ids array<string>, is_latest_edition boolean, s double"


def row(i, doc, order, text, group=None, index=None, label="l", latest=False, s=0.5, tokens=10, active=True):
    return (i, doc, "1", "N", label, active, "text", order, group, index, f"text-{i}", text, [f"H{order}"], tokens, [], latest, s)


def test_results(spark):
    chunks = spark.createDataFrame(
        [
            row(1, "a", 0, "a0"), row(2, "a", 1, "a1x", "g", 1), row(3, "a", 1, "a1y", "g", 2), row(4, "a", 2, "a2"), row(5, "a", 3, "a3", tokens=100),
            row(6, "b", 0, "b0", label="m", latest=True), row(7, "b", 1, "b1", label="m", latest=True), row(8, "c", 0, "c0"), row(9, "a", 4, "gone", active=False),
        ],
        SCHEMA,
    )
    keyword = spark.createDataFrame([(1, 3, 1), (1, 8, 2), (1, 6, 3), (1, 9, 4), (2, 7, 1)], "q int, chunk_id int, rank int")
    dense = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (1, 8, 3)], "q int, chunk_id int, rank int")
    got = {(r.q, r["rank"]): r for r in search.results([keyword, dense], chunks, "q", 5, 25).collect()}
    # 3: 1/61 + 1/62 stands for its group with 2; 8: 1/62 + 1/63; 6: 1/63; the inactive 9 is no hit
    assert [(k, r.doc_id, r.chunks, r.before, r.after) for k, r in sorted(got.items())] == [
        ((1, 1), "a", ["a1x", "a1y"], ["a0"], ["a2"]), ((1, 2), "c", ["c0"], [], []), ((1, 3), "b", ["b0"], [], ["b1"]), ((2, 1), "b", ["b1"], ["b0"], []),
    ]
    assert got[1, 1].heading_path == ["H1"] and got[1, 1].score == pytest.approx(1 / 61 + 1 / 62) and got[1, 3].other_editions and not got[2, 1].other_editions
    # the latest edition's weight and a rerank score put 6 first; invisible documents go
    documents = spark.createDataFrame([("a", False, "replaced"), ("b", False, "searchable"), ("c", True, "searchable")], "doc_id string, deleted boolean, search_state string")
    top = search.results([keyword, dense], chunks, "q", 1, 0, F.col("s"), 0.3).collect()
    assert {(r.q, r.doc_id, r.score) for r in top} == {(1, "b", 0.8), (2, "b", 0.8)}
    seen = search.results([keyword, dense], chunks, "q", 5, 0, documents=documents).collect()
    assert {(r.q, r["rank"], r.doc_id, r.other_editions) for r in seen} == {(1, 1, "b", False), (2, 1, "b", False)}


@pytest.mark.parametrize("n", [0, 51])
def test_bounds(spark, n):
    with pytest.raises(ValueError, match="1 to 50"):
        rt.candidate_limit(n)
    with pytest.raises(ValueError, match="1 to 50"):
        search.results([], spark.range(1), "q", n, 1)


def test_coverage_is_the_union_of_the_longest_parts(spark):
    r, cases, hits, want = random.Random(5), [], [], {}
    for case in range(40):
        span = "".join(r.choices("abc", k=r.randint(5, 40)))
        covered = set()
        for rank in range(1, r.randint(2, 8)):
            a = r.randrange(len(span))
            body = "".join(r.choices("abc", k=5)) + span[a : a + r.randint(1, 25)] + "".join(r.choices("abc", k=5))
            size, start = max((n, -i) for n in range(len(span) + 1) for i in range(len(span) - n + 1) if span[i : i + n] in body)
            if size >= min(ev.LEAST_COVER, len(span)):
                covered |= set(range(-start, -start + size))
            hits.append((case, rank, "d", "n", body))
        cases.append((case, False, "d", "n", span))
        want[case] = len(covered) / len(span)
    h = spark.createDataFrame(hits, "case_id int, rank int, doc_id string, name string, text string")
    c = spark.createDataFrame(cases, "case_id int, edition_only boolean, doc_id string, name string, answer_span string")
    got = ev.metrics(h, c, ev.body([F.array("text")]))
    assert {x.case_id: x.coverage for x in got.collect()} == pytest.approx(want)
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("block", [2, 10_000])
def test_keyword_search_of_texts_makes_no_rows_of_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(rt, "QUERY_BLOCK", block)
    monkeypatch.setattr(rt, "TILE", 7)
    r, words = random.Random(3), [f"w{i}" for i in range(12)]
    texts = [((i, i % 3), " ".join(r.choices(words, k=r.randint(1, 9)))) for i in range(120)] + [((200, 0), None), ((201, 0), "- ")]
    asked = [(q, " ".join(r.choices(words, k=3))) for q in range(5)] + [(0, "w1 W2"), (8, "none"), (9, None)]
    chunks = spark.createDataFrame(texts, "k struct<a: int, b: int>, text string").repartition(3)
    queries = spark.createDataFrame(asked, "q int, text string")
    got = rt.keyword_search_texts(chunks, queries, "k", "text", "q", "text", 7)
    held = {k: t.split() for k, t in texts if t and t != "- "}
    df = {w: sum(w in t for t in held.values()) for w in words}
    want = set()
    for q in {q for q, _ in asked}:
        terms = {w for k, t in asked if k == q and t for w in t.lower().split()} & set(words)
        score = {k: sum(t.count(w) * math.log(1 + (len(held) - df[w] + 0.5) / (df[w] + 0.5)) for w in terms) for k, t in held.items() if terms & set(t)}
        want |= {(q, i + 1, k, round(score[k], 6)) for i, k in enumerate(sorted(score, key=lambda k: (-round(score[k], 9), k))[:7])}
    assert {(x.q, x["rank"], tuple(x.k), round(x.score, 6)) for x in got.collect()} == want
    from folioscope import plans

    plan = plans.queries()["k06_keyword_search"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" in plan
