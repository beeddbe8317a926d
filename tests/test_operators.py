"""Small cases with hand-computed results."""

import math
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import assets, chunking, glossary, models
from folioscope.operators import catalog as cat
from folioscope.operators import evaluation as ev
from folioscope.operators import retrieval as rt
from folioscope.operators import versions as vs
from folioscope.sources.store import Store, uploads
from folioscope.streaming import events as st


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr).first()[0]


def test_terms(spark):
    assert one(spark, tx.terms(F.col("t")), t="인증서를 API_key+key") == ["인증서를", "인증", "증서", "서를", "api", "key", "key"]
    assert one(spark, tx.terms(F.col("t")), t="인증") == ["인증"]
    assert one(spark, tx.terms(tx.nfkc(F.col("t"))), t="ＡＰＩ") == ["api"]


def test_placeholders(spark):
    t = "a [[asset:table:t1 | rows]] b [[asset:image:i1 | x]]] c [[asset:image:i2 | ]]"
    assert one(spark, tx.placeholder_ids(F.col("t")), t=t) == ["t1", "i1"]
    assert one(spark, F.size(F.split("t", tx.loose_placeholder())), t=t) == 4
    guarded = one(spark, tx.guard(F.col("t")), t="[[asset:table:")
    assert guarded != "[[asset:table:" and one(spark, tx.unguard(F.col("t")), t=guarded) == "[[asset:table:"
    assert one(spark, tx.unguard(F.col("t")), t=one(spark, tx.guard(F.col("t")), t=guarded)) == guarded
    assert one(spark, tx.clean_description(F.col("t"), "none"), t="a\nb ]] c]]") == "a b c"
    assert one(spark, tx.clean_description(F.col("t"), "none"), t="..]") == "none"


def test_scalars(spark):
    assert one(spark, tx.strip_space(F.col("t")), t="a b　c\x85​") == "abc\x85​"
    assert one(spark, tx.particle(F.col("t"), "을", "를"), t="문서") == "문서를"
    assert one(spark, tx.particle(F.col("t"), "을", "를"), t="판") == "판을"
    assert one(spark, tx.previous_version(F.col("t")), t="1") is None
    assert one(spark, tx.newer(F.lit("10"), F.lit("9")))
    assert one(spark, tx.byte_size(F.lit(3 << 20))) == "3MB"
    assert one(spark, tx.content_type(F.col("t")), t="a/b/c.JPG?x=1") == "image/jpeg"
    assert one(spark, F.date_format(tx.kst_day(F.lit("2024-03-01"))[0], "yyyy-MM-dd HH")) == "2024-02-29 15"
    assert one(spark, tx.kst_day(F.lit("2024-02-30"))[0]) is None
    assert one(spark, tx.bounded(F.lit("cert 갱신"), F.lit("cert"))) and not one(spark, tx.bounded(F.lit("concert"), F.lit("cert")))
    assert tx.longest_common("ABCDEFGHIJ", "xxCDEFyyABC") == (2, 4)
    assert one(spark, tx.index_decision(F.lit("c"), F.lit("j"), F.lit(None), F.lit(None), F.lit(True))) == "join"
    assert one(spark, tx.index_decision(F.lit("c"), F.lit(None), F.lit("j"), F.lit("c"), F.lit(False))) == "reuse"
    assert one(spark, tx.index_decision(F.lit("c"), F.lit(None), F.lit("j"), F.lit("c"), F.lit(True))) == "submit"
    assert one(spark, tx.span_in_one_zone(F.lit("ab [[asset:table:t1 | x]] cd"), F.lit("b c"))) is False


def test_fusion_and_groups(spark):
    a = spark.createDataFrame([(1, "A", 1), (1, "B", 2), (1, "C", 3)], "q int, k string, rank int")
    b = spark.createDataFrame([(1, "A", 1), (1, "C", 2)], "q int, k string, rank int")
    assert [r.k for r in rt.fuse([a, b], "q", "k").orderBy("fused_rank").collect()] == ["A", "C", "B"]
    rows = spark.createDataFrame([(1, "f1", 0.1, 1, 0.3, True), (1, "f2", 0.1, 2, 0.6, True)], "q int, k string, fused double, fused_rank int, s double, latest boolean")
    ranked = rt.rerank(rows, "q", F.col("s"), F.col("latest"), 0.25).withColumns({"doc_id": F.lit("d"), "version": F.lit("1"), "split_group": F.lit("g")})
    got = rt.group_fragments(ranked, "q", "k", 5).collect()
    assert len(got) == 1 and abs(got[0].score - 0.85) < 1e-9 and got[0].members == ["f2", "f1"]
    broken = rows.withColumn("s", F.when(F.col("k") == "f1", float("nan")).otherwise(F.col("s")))
    assert {r.base for r in rt.rerank(broken, "q", F.col("s"), F.col("latest")).collect()} == {0.1}
    with pytest.raises(ValueError):
        rt.scope(*[F.lit(True)] * 6, "SPECIFIC")


@pytest.mark.parametrize(
    "hit, n, cap, odd, before, after",
    [(3, 5, 25, {}, [2], [4]), (3, 5, 30, {}, [1, 2], [4]), (2, 3, 20, {1: 50}, [], []), (2, 3, 0, {}, [], []), (4, 7, 40, {6: 50}, [2, 3], [5]), (1, 4, 20, {}, [], [2, 3]), (4, 4, 20, {}, [2, 3], [])],
)
def test_neighbours(spark, hit, n, cap, odd, before, after):
    c = spark.createDataFrame([("d", "1", True, "text", i, None, f"c{i}", i, odd.get(i, 10), []) for i in range(1, n + 1)], "doc_id string, version string, active boolean, kind string, order int, split_index int, chunk_key string, chunk_id int, tokens int, placeholder_ids array<string>")
    h = spark.createDataFrame([(0, "d", "1", [hit], None, [])], "hit_id int, doc_id string, version string, members array<int>, asset_order int, placeholder_ids array<string>")
    got = rt.neighbours(h, c, cap).first()
    assert (got.before, got.after) == (before, after)


def test_asset_neighbours(spark):
    c = spark.createDataFrame([("d", "1", True, "text", i, None, f"c{i}", i, 10, ["a2"] if i == 2 else []) for i in (1, 2, 3)], "doc_id string, version string, active boolean, kind string, order int, split_index int, chunk_key string, chunk_id int, tokens int, placeholder_ids array<string>")
    h = spark.createDataFrame([(0, "d", "1", [99], 2, ["a2"])], "hit_id int, doc_id string, version string, members array<int>, asset_order int, placeholder_ids array<string>")
    got = rt.neighbours(h, c, 1000).first()
    assert (got.before, got.after) == ([1, 2], [3])


SPAN = "ABCDEFGHIJKLMNOPQRST"


@pytest.mark.parametrize("body, cover", [(["xxxx" + SPAN[:10], SPAN[10:] + "yyyy"], 1.0), (["xx" + SPAN[:9] + "yy"], 0.0), (["xx" + SPAN[:10] + "yy"], 0.5), ([SPAN[:9], SPAN[11:]], 0.0), ([SPAN[:12] + "xx" + SPAN[14:]], 0.6), ([SPAN[:15], SPAN[5:]], 1.0), (["x" + SPAN + "y"], 1.0)])
def test_coverage(spark, body, cover):
    hits = spark.createDataFrame([(1, i + 1, "d", "other", b) for i, b in enumerate(body)], "case_id int, rank int, doc_id string, name string, text string")
    cases = spark.createDataFrame([(1, False, "d", "n", SPAN)], "case_id int, edition_only boolean, doc_id string, name string, answer_span string")
    got = ev.metrics(hits, cases, ev.body([F.array("text")])).first()
    assert got["rank"] is None and abs(got.coverage - cover) < 1e-9


def test_roll_up(spark):
    m = "struct<hit_at_1:boolean,hit_at_3:boolean,hit_at_5:boolean,hit_at_n:boolean,reciprocal_rank:double>"
    hit, miss = (True, True, True, True, 1.0), (False, False, False, False, 0.0)
    r = spark.createDataFrame([(1, "hit", 10, miss, hit, 1), (2, "miss", 10, miss, miss, 2), (3, "error", None, None, None, None)], f"record_id int, outcome string, n int, base {m}, expanded {m}, evaluated_at int")
    got = ev.roll_up(r).first()
    assert (got["count"], got.evaluating, got.expanded_hit_at_1, got.expanded_mrr, got.base_mrr, got.n) == (3, 0, 0.5, 0.5, 0.0, 10)
    assert ev.roll_up(r.limit(0)).first().expanded_mrr == 0


def test_chunking(spark):
    t = "머리\n\n# 설치\n본문 하나.\n\n## Docker\n```\n# not a heading\n```\n\n## 환경\n변수 [[asset:table:t1 | rows]] 끝"
    got = chunking.chunks_of(t, 100)
    assert [c["chunk_key"] for c in got] == ["text-0", "text-1", "text-2", "text-3", "asset-0"]
    assert got[2]["heading_path"] == ["설치", "Docker"] and got[4]["heading_path"] == ["설치", "환경"] and got[0]["heading_path"] == []
    long = "# A\n" + " ".join(f"w{i}. Next{i}" for i in range(40))
    parts = [c for c in chunking.chunks_of(long, 20)]
    assert len(parts) > 2 and all(len(c["text"].replace(".", " ").split()) <= 21 for c in parts) and {c["split_total"] for c in parts} == {len(parts)}
    code = chunking.chunks_of("```py\n" + "\n".join(f"a{i} b{i}" for i in range(30)) + "\n```", 20)
    assert len(code) > 1 and all(c["text"].startswith("```py\n") and c["text"].endswith("\n```") for c in code)
    df = spark.createDataFrame([(1, t), (2, None), (3, " ")], "doc_id int, text string")
    assert chunking.chunk(df, "doc_id", "text").count() == 5
    assert [c["text"] for c in chunking.chunks_of("# only\n\n## headings", 100)] == ["# only\n\n## headings"]


def test_assets(spark):
    t = "intro\n\n| a | b |\n|---|---|\n| 1 | ![x](p.png) |\n\n![cap](img/q.png) `![no](n.png)` <img src=\"r.png\" alt='z'>\n<table><tr><th>H</th></tr><tr><td>v</td></tr></table>\n```\n| c | d |\n|---|---|\n```\n"
    out, found = assets.extract(t)
    assert [(a["id"], a["kind"], a["table_id"]) for a in found] == [("t1", "table", None), ("i1", "image", "t1"), ("i2", "image", None), ("i3", "image", None), ("t2", "table", None)]
    assert "[[asset:table:t1 | a, b]]" in out and "[[asset:image:i3 | z]]" in out and "![no](n.png)" in out
    rows = spark.createDataFrame([(1, out), (2, "none [[asset:table:t9 | q]]")], "doc_id int, text string")
    src = spark.createDataFrame([(1, a["id"], a["kind"], a["markdown"]) for a in found if not a["table_id"]], "doc_id int, placeholder_id string, kind string, source string")
    got = {r.doc_id: r.text for r in assets.restore(rows, src).collect()}
    assert got[1] == t and got[2] == "none [[asset:table:t9 | q]]"


def test_extraction_is_quick():
    import time

    start = time.time()
    for bad in ("<table>" * 20000, "![a](b" * 20000, "<" * 100000, "| a\n" * 16000, "<table>\n" * 16000, "![x](y.png) " * 16000):
        assets.extract(bad)
    assert time.time() - start < 10


def test_glossary(spark):
    g = spark.createDataFrame(glossary.checked([["인증서", "certificate", "cert", "인증 문서"], ["폐기 목록", "CRL"]]), "group_no int, pos int, word string, norm string")
    q = spark.createDataFrame([(1, "cert 갱신"), (2, "날씨 어때")], "q int, t string")
    got = {r.q: r for r in glossary.expand(q, g, "q", "t").collect()}
    assert got[1].sentence == "인증서 갱신" and got[1].keyword_text == "cert 갱신 인증서 certificate 인증 문서"
    assert got[2].sentence == got[2].keyword_text == "날씨 어때"
    for bad in ([["a"]], [["a", "A"]], [["a", ""]], "x", [["a", 1]]):
        with pytest.raises(ValueError):
            glossary.checked(bad)


def test_editions_and_jobs(spark):
    r = spark.createDataFrame([("a", "n", True, "2022-01-01"), ("b", "n", True, "2025-01-01"), ("c", "n", True, None), ("d", "n", False, "2030-01-01")], "doc_id string, name string, active boolean, edition_date string")
    assert {x.doc_id for x in vs.refresh_latest(r).where("is_latest_edition").collect()} == {"b"}
    old = spark.createDataFrame([("a", "j1", "queued", 1), ("b", "j2", "running", 2)], "doc_id string, job_id string, state string, accepted_order long")
    new = spark.createDataFrame([("a", "j3", 1)], "doc_id string, job_id string, pos int")
    assert {(x.job_id, x.state, x.accepted_order) for x in vs.submit(old, new).collect()} == {("j1", "superseded", 1), ("j2", "running", 2), ("j3", "queued", 3)}


def test_events(spark, tmp_path):
    e = spark.createDataFrame([("d", s, i, "running") for i, s in enumerate((3, 1, 3, 5))], "doc_id string, sequence long, arrival long, job_state string")
    assert [r.sequence for r in st.accepted(e).orderBy("arrival").collect()] == [3, 5]
    e.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = st.accepted_stream(stream).writeStream.format("memory").queryName("got").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.sequence for r in spark.table("got").orderBy("arrival").collect()] == [3, 5]
    d = spark.createDataFrame([("d", "1", "j", "queued", None)], "doc_id string, latest_version string, job_id string, state string, searchable_version string")
    ev_ = spark.createDataFrame([("d", "1", "j", 1, 0, "running", None), ("d", "1", "j", 2, 1, "succeeded", "1")], "doc_id string, version string, job_id string, sequence long, arrival long, job_state string, searchable_version string")
    got = st.apply_events(d, ev_).first()
    assert (got.state, got.searchable_version) == ("completed", "1")
    raw = spark.createDataFrame([('{"doc_id":"d","job_id":"j","version":"1","job_state":"running","index_state":{},"sequence":1}',), ('{"doc_id":"d","sequence":1,"x":2}',), ("nope",)], "body string")
    assert [r.fault for r in st.received(raw, "body").collect()] == [None, "invalid", "invalid"]


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"))
    assert s.read() is None
    s.publish(spark.createDataFrame([("d", True)], "doc_id string, active boolean"))
    s.publish(s.read().unionByName(spark.createDataFrame([("e", True)], "doc_id string, active boolean")))
    assert s.read().count() == 2 and s.active("e").count() == 1
    (tmp_path / "u").mkdir()
    (tmp_path / "u/a.md").write_bytes("가".encode())
    (tmp_path / "u/b.md").write_bytes(b"\xff\xfe")
    (tmp_path / "u/c.exe").write_bytes(b"x")
    assert {r.name: r.fault for r in uploads(spark, str(tmp_path / "u")).collect()} == {"a.md": None, "b.md": "not_utf8", "c.exe": "unsupported"}


def test_models_and_cron(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, "c")], "k int, t string")
    got = models.apply_model(rows, ["t"], "size", "int", lambda: lambda ts: [len(t) for t in ts]).collect()
    assert {(r.k, r["size"]) for r in got} == {(1, 2), (2, 1)}
    with pytest.raises(ValueError):
        models.apply_model(rows, ["t"], "size", "int", None)
    assert models.next_run("0 0 * * *", datetime(2024, 1, 1, 12, tzinfo=timezone.utc)) == datetime(2024, 1, 1, 15, tzinfo=timezone.utc)
    assert models.next_run("0 0 30 2 *", datetime(2024, 1, 1, tzinfo=timezone.utc)) is None
    assert models.longest_prefix(["a", "bb", "c"], lambda s: len(s) <= 4) == "a\nbb"


def test_catalogue(spark):
    assert one(spark, cat.may_go(F.lit("indexing"), F.lit("completed"))) and not one(spark, cat.may_go(F.lit("failed"), F.lit("completed")))
    assert one(spark, cat.accepts_change("edit", F.lit("queued"), F.lit("searchable"), F.lit("2"), F.lit("2")))
    assert not one(spark, cat.accepts_change("reindex", F.lit("queued"), F.lit("searchable"), F.lit("2"), F.lit("2")))
    assert one(spark, cat.describe(F.lit("edit"), F.lit("success"), F.lit("이름"), F.lit(None), F.lit(None))) == "이름을 고쳤습니다"
    with pytest.raises(ValueError):
        cat.page(spark.range(3), [F.col("id")], 0, 20)
    assert one(spark, cat.wire(F.struct(F.lit(None).cast("string").alias("a")))) == '{"a":null}'


def test_job_steps(spark):
    jobs = spark.createDataFrame([(i, "d", "queued", None, None, None) for i in range(5)], "job_id int, doc_id string, state string, stage string, failure_code string, chunk_count bigint")
    steps = [(0, 1, "start", None, None), (0, 2, "succeed", None, 7), (0, 3, "fail", "INTERNAL_ERROR", None), (1, 2, "start", None, None), (1, 1, "succeed", None, 7), (2, 1, "start", None, None), (2, 2, "fail", "STORE_UNAVAILABLE", None), (3, 1, "fail_queued", "odd", None)]
    got = vs.job_steps(jobs, spark.createDataFrame(steps, "job_id int, arrival int, step string, code string, chunk_count int"))
    assert got.columns == jobs.columns
    assert {r["job_id"]: tuple(r)[2:] for r in got.collect()} == {
        0: ("succeeded", None, None, 7),
        1: ("running", "chunking", None, None),
        2: ("failed", None, "STORE_UNAVAILABLE", None),
        3: ("failed", None, "INTERNAL_ERROR", None),
        4: ("queued", None, None, None),
    }


def test_paths_in_tables(spark):
    tables = spark.createDataFrame([(1, "t1", "0123456789"), (1, "t2", "ab"), (2, "t1", None)], "doc_id int, placeholder_id string, source string")
    spots = [(1, "t1", 6, 8, "Y"), (1, "t1", 2, 4, "X"), (1, "t1", 3, 5, "overlap"), (1, "t1", 9, 11, "beyond"), (1, "t1", 9, 8, "turned"), (1, "t2", None, 1, "no"), (2, "t1", 0, 1, "z")]
    images = spark.createDataFrame(spots, "doc_id int, table_id string, start int, end int, url string")
    assert sorted((r["doc_id"], r["placeholder_id"], r["source"]) for r in assets.rewrite_paths(tables, images).collect()) == [(1, "t1", "01X45Y89"), (1, "t2", "ab"), (2, "t1", None)]




@pytest.mark.parametrize(
    "response, fault",
    [
        ('{"chunks": [{"start_line": 1, "end_line": 2, "title": " t ", "summary": "s"}]}', None),
        ('{"chunks": [{"start_line": 3, "end_line": 3, "title": "", "summary": ""}]}', None),
        ('{"chunks": [{"start_line": 1, "end_line": 2, "title": "t", "summary": " "}]}', "empty_summary"),
        ('{"chunks": [{"start_line": 1, "end_line": 2, "summary": "s"}]}', "empty_title"),
        ('{"chunks": [{"start_line": 0, "end_line": 2, "title": "t", "summary": "s"}]}', "line_out_of_range"),
        ('{"chunks": [{"start_line": true, "end_line": 2, "title": "t", "summary": "s"}]}', "bad_item"),
        ('{"chunks": [{"start_line": 1.5, "end_line": 2, "title": "t", "summary": "s"}]}', "bad_item"),
        ('{"chunks": [{"start_line": "1", "end_line": 2, "title": "t", "summary": "s"}]}', "bad_item"),
        ('{"chunks": [3]}', "bad_item"),
        ('{"chunks": []}', "no_chunks"),
        ('{"chunks": 3}', "no_chunks"),
        ("{}", "no_chunks"),
        ("[]", "not_json"),
        ("no", "not_json"),
        (None, "not_json"),
    ],
)
def test_model_response(spark, response, fault):
    rows = spark.createDataFrame([(response, "a\nb\n \nc")], "response string, text string")
    got = chunking.parsed_boundaries(rows).first()
    assert got["fault"] == fault
    if response and fault is None and '" t "' in response:
        assert [tuple(s) for s in got["sections"]] == [(1, 2, "t", "s")]


def test_views(spark):
    row = spark.createDataFrame([(1, datetime(2024, 1, 2, 3, 4, 5, 999999), "edit", "d", "n", None, False, "success", "x")], "log_id int, occurred_at timestamp, kind string, doc_id string, name string, edition_label string, document_deleted boolean, outcome string, description string")
    sent = cat.log_view(row).first()
    assert sent["occurred_at"].endswith(":05Z") and sent["document"].asDict() == {"doc_id": "d", "name": "n", "edition_label": None}
    ask = spark.createDataFrame([(1, "d"), (2, "gone")], "id int, doc_id string")
    refs = spark.createDataFrame([("d", "n", None)], "doc_id string, name string, label string")
    assert {r["id"]: r["answer_name"] for r in cat.answer_view(ask, refs).collect()} == {1: "n", 2: cat.UNKNOWN}
    assert one(spark, cat.unwire(F.col("t"), "a int, b string"), t='{"a": 1, "z": 2}').asDict() == {"a": 1, "b": None}
    assert one(spark, cat.unwire(F.col("t"), "a int"), t="[1]") is None


def test_search_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id int, e array<double>")
    q = v.where("vec_id % 3 = 0").select(F.col("vec_id").alias("q_id"), F.col("e").alias("qe"))
    run = lambda: sorted(map(tuple, rt.dense_search(v, q, "vec_id", "e", "q_id", "qe", 4).collect()))
    whole = run()
    monkeypatch.setattr(rt, "QUERY_BLOCK", 6)
    assert run() == whole and len(whole) == 80


@pytest.mark.parametrize("scoring", ["tfidf", "bm25"])
def test_keyword_scores(spark, scoring):
    texts = {1: "a a b", 2: "b c", 3: "c c c d", 4: "", 5: None, 6: "..."}
    chunks = spark.createDataFrame(list(texts.items()), "id int, text string")
    asked = spark.createDataFrame([(1, "A b a"), (2, "zzz"), (3, None)], "q int, text string")
    got = {(r["q"], r["id"]): r["score"] for r in rt.keyword_search(rt.postings(chunks, "id", "text"), asked, "id", "q", "text", 10, scoring).collect()}
    split = {k: t.split() for k, t in texts.items() if t and t != "..."}
    n, avg = len(split), sum(map(len, split.values())) / len(split)
    want = {}
    for k, w in split.items():
        for t in {"a", "b"} & set(w):
            df, tf = sum(t in x for x in split.values()), w.count(t)
            idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
            part = tf if scoring == "tfidf" else tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
            want[1, k] = want.get((1, k), 0) + idf * part
    assert got == pytest.approx(want)
    assert rt.searchable_count(chunks, "text") == n
    known = rt.keyword_search(rt.postings(chunks, "id", "text"), asked, "id", "q", "text", 10, total=n)
    if scoring == "tfidf":
        assert {(r["q"], r["id"]): r["score"] for r in known.collect()} == pytest.approx(want)


def test_common_span():
    texts = ["", "ab", "xabcx", "abcab", "bcabc", "cabxab"]
    for a in texts:
        for b in texts:
            found = [(-n, i) for i in range(len(a)) for n in range(1, len(a) - i + 1) if a[i : i + n] in b]
            n, i = min(found) if found else (0, 0)
            assert tx.longest_common(a, b) == (i, -n)


def test_ordered_sink(spark, tmp_path):
    log = str(tmp_path / "log")

    def send(row):
        with open(log, "a") as f:
            f.write(f"{row['doc_id']} {row['sequence']}\n")

    rows = spark.createDataFrame([("a", 3), ("b", 1), ("a", 1), ("a", 2)], "doc_id string, sequence long")
    st.ordered_sink(send)(rows, 0)
    sent = [line.split() for line in open(log)]
    assert [s for d, s in sent if d == "a"] == ["1", "2", "3"] and len(sent) == 4


def test_glossary_file(spark, tmp_path):
    path = tmp_path / "words.yaml"
    path.write_text("groups:\n- [cert, Certificate]\n")
    g = glossary.Glossary(str(path))
    assert [r["norm"] for r in g.table(spark).orderBy("pos").collect()] == ["cert", "certificate"]
    path.write_text("groups:\n- [alone]\n# faulty: one word\n")
    assert g.table(spark).count() == 2
    path.write_text("groups:\n- [a, b, c]\n")
    assert g.table(spark).count() == 3


def random_markdown(r):
    rows = []
    for _ in range(r.randint(1, 25)):
        kind = r.random()
        words_ = " ".join(f"w{r.randint(0, 99)}" + r.choice(["", ".", "!", "。"]) for _ in range(r.randint(1, 12)))
        rows.append("#" * r.randint(1, 4) + " " + words_ if kind < 0.2 else "" if kind < 0.45 else f"```\n{words_}\n# no heading\n\n{words_}\n```" if kind < 0.55 else f"1. {words_} [[asset:table:t{len(rows)} | a. b]] end" if kind < 0.65 else words_)
    return r.choice(["\n", "\r\n"]).join(rows)


def test_chunk_parts_cover_the_text():
    import random

    r = random.Random(8)
    for _ in range(300):
        t = random_markdown(r)
        if not t.strip():
            continue
        o = chunking.Outline(t)
        assert "".join(t[a.start : a.end] for a in o.atoms) == t
        limit = r.choice([5, 15, 40])
        spans = o.fitted(0, len(o.atoms), limit)
        assert [s[0] for s in spans] == [0, *(s[1] for s in spans[:-1])] and spans[-1][1] == len(o.atoms)
        for a, b in spans:
            # what is too long has no cut with a body on both sides
            assert o.size(a, b) <= limit or sum(x.body for x in o.atoms[a:b]) <= 1
        assert "".join(chunking.presplit(t, limit)) == t
        for lo, hi in o.parts(0, len(o.atoms), chunking.HEADING):
            starts = [x for x in o.atoms[lo:hi] if x.body]
            assert starts or not any(x.body for x in o.atoms)
        made = chunking.chunks_of(t, limit)
        assert sum(c["kind"] == "asset" for c in made) == t.count("[[asset:")


def test_sentences_are_not_cut_in_placeholders_or_lists():
    cuts = lambda t: [t[a.start : a.end] for a in chunking.atoms_of(t)]
    assert cuts("One. Two! 셋。넷") == ["One. ", "Two! ", "셋。", "넷"]
    assert cuts("3. Item. Next") == ["3. Item. ", "Next"]
    assert cuts("a [[asset:table:t1 | x. y]] b. ") == ["a [[asset:table:t1 | x. y]] b. "]
    assert cuts("# A. B\n\ntext") == ["# A. B\n\n", "text"]
    assert [a.cost for a in chunking.atoms_of("# A\nx\n\ny\n## B\n~~~\nz")] == [1, 8, 7, 2, 8]


def test_code_pieces_keep_fences():
    t = "# C\r\n```py\r\n" + "".join(f"a{i} b{i}\r\n" for i in range(6)) + "```\r\n"
    got = [c["text"] for c in chunking.chunks_of(t, 5)]
    assert got == ["# C\r\n```py\r\na0 b0\r\na1 b1\r\n```", "```py\r\na2 b2\r\na3 b3\r\n```", "```py\r\na4 b4\r\na5 b5\r\n```"]
    assert [c["text"] for c in chunking.chunks_of("~~~\none\ntwo\n\n", 1)] == ["~~~\none\n~~~", "~~~\ntwo\n~~~"]
    assert len(chunking.chunks_of("```\n" + "w " * 50 + "\n```", 5)) == 1


def test_model_boundaries():
    t = "a\n\n```\nx\ny\n```\n[[asset:table:t1 | d]]\nend"
    good = [(1, 1, "A", "s"), (3, 8, "B", "s")]
    assert chunking.boundary_fault(t, good) is None
    cases = {"empty": [], "bounds": [(0, 8, "", "")], "order": [(1, 4, "", ""), (3, 8, "", "")], "uncovered": [(1, 1, "", ""), (4, 8, "", "")], "in_code": [(1, 3, "", ""), (4, 8, "", "")]}
    for fault, found in cases.items():
        assert chunking.boundary_fault(t, found) == fault
    assert chunking.boundary_fault(t, good[:1]) == "uncovered"
    answers = iter([None, cases["order"], good])
    asked = []
    assert chunking.model_sections(t, lambda text, fault: (asked.append(fault), next(answers))[1]) == (good, None)
    assert asked == [None, "no_answer", "order"]
    assert chunking.model_sections(t, lambda text, fault: cases["order"]) == (None, "order")
    made = chunking.chunks_of(t, 100, sections=good)
    assert [(c["chunk_key"], c["title"]) for c in made] == [("text-0", "A"), ("text-1", "B"), ("asset-0", None)]


def test_chunk_limits_by_another_measure(spark):
    df = spark.createDataFrame([(1, "aaa bb. cc dd. eeeee")], "doc_id int, text string")
    assert [r.text for r in chunking.chunk(df, "doc_id", "text", 8, measure=len).collect()] == ["aaa bb.", "cc dd.", "eeeee"]


def test_edition_counts(spark):
    rows = [(1, "a", "x", False, "searchable"), (2, "a", "x", False, "searchable"), (3, "a", "x", True, "searchable"), (4, "a", None, False, "searchable"), (5, "b", None, False, "replaced")]
    df = spark.createDataFrame(rows, "doc_id int, name string, label string, deleted boolean, search_state string")
    got = {r.doc_id: (r.n_others, r.first_id) for r in cat.edition_counts(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (2, 1), 4: (0, 4), 5: (0, None)}
    pairs = cat.same_edition(df, df).groupBy("other_id").count().collect()
    assert {r.other_id: r["count"] for r in pairs} == {1: 1, 2: 1, 3: 2}


def test_attributes():
    got = assets.attributes("src=a.png alt='x > \"y\"' hidden ALT=z data-q=\"1 &amp; 2\" src=\"b.png\" / checked")
    assert got == {"src": "a.png", "alt": 'x > "y"', "hidden": "", "data-q": "1 & 2", "checked": ""}


def test_evaluate(spark):
    cases = spark.createDataFrame([(1, False, "d", "n", "A B"), (2, False, "d", "n", "C"), (3, True, "e", "n", "A")], "case_id int, edition_only boolean, doc_id string, name string, answer_span string")
    hits = spark.createDataFrame([(1, 1, "d", "n", ["xA"], [], ["By"]), (2, 11, "d", "n", ["C"], [], []), (3, 1, "d", "n", ["A"], [], []), (3, 2, "e", "n", ["A"], [], [])], "case_id int, rank int, doc_id string, name string, chunks array<string>, before array<string>, after array<string>")
    got = {r.case_id: r for r in ev.evaluate(cases, hits).collect()}
    assert [got[i].outcome for i in (1, 2, 3)] == ["hit", "miss", "hit"]
    assert got[1].base["rank"] is None and got[1].expanded["rank"] == 1 and got[3].expanded["rank"] == 2 and not got[3].base.hit_at_1


def test_redaction_and_payloads(spark):
    from pyspark.sql import functions as F

    from folioscope.functions import nested

    rows = spark.range(2).select(
        F.col("id"),
        F.when(F.col("id") == 0, F.struct(F.lit("s").alias("Password"), F.array(F.struct(F.lit(1).alias("token"), F.lit(2).alias("n"))).alias("xs"))).alias("a"),
        F.create_map(F.lit("token"), F.lit("t"), F.lit("k"), F.lit("v")).alias("m"),
    )
    got = nested.without_secrets(rows, ["password", "TOKEN"]).orderBy("id").collect()
    assert got[0].a.asDict(True) == {"Password": "[redacted]", "xs": [{"token": "[redacted]", "n": 2}]}
    assert got[1].a is None and got[0].m == {"token": "[redacted]", "k": "v"}
    flat = spark.createDataFrame([(1, None, 'a\\"b\n', [1.5, None]), (None, "x", "", [])], "doc_id int, edition string, text string, v array<double>")
    back = nested.from_payload(nested.to_payload(flat, "doc_id"), "doc_id", flat.schema)
    assert back.schema == flat.schema and sorted(map(str, back.collect())) == sorted(map(str, flat.collect()))


def test_term_numbers(spark):
    from hashlib import blake2b

    df = spark.createDataFrame([("인증",), ("api",), (None,), ("api",)], "t string")
    want = [int.from_bytes(blake2b(t.encode(), digest_size=4).digest(), "big") if t else None for t in ("인증", "api", None, "api")]
    assert [r.n for r in df.select(tx.term_number("t").alias("n")).collect()] == want


def test_editions_are_collected_once_for_a_name(spark):
    from folioscope.operators import catalog as cat

    docs = spark.range(200).selectExpr("id AS doc_id", "'n' AS name", "cast(id % 3 AS string) AS label", "date_add(date'2024-01-01', cast(id % 2 AS int)) AS edition_date", "id = 0 AS deleted", "'searchable' AS search_state")
    got = cat.siblings(docs)
    assert {tuple((x.label, x.edition_date.day) for x in r.editions) for r in got.collect()} == {(("0", 2), ("1", 2), ("2", 2), ("0", 1), ("1", 1), ("2", 1))}
    # no row for each document and edition
    assert "Generate" not in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and plan.count("Join") == 1


def test_numbers_of_arrays_of_terms(spark, monkeypatch):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None)], "k int, t array<string>")
    one = {r.t: r.n for r in spark.createDataFrame([("a",), ("b",)], "t string").select("t", tx.term_number("t").alias("n")).collect()}
    assert {r.k: r.n for r in df.select("k", tx.term_numbers("t").alias("n")).collect()} == {1: [one["a"], one["b"], one["a"]], 2: [], 3: None}
