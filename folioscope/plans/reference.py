"""Queries of the retrieval, catalogue, log and evaluation operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import catalog as cat
from ..operators import evaluation as ev
from ..operators import retrieval as rt
from ..operators import search
from ..operators import versions as vs
from ..operators.keyword_index import KeywordIndex, blocks_of
from ..sources.log import work_folder
from ..sources.store import spread
from ..streaming import events as st
from .base import query
from .corpus import DOCS_SQL, LINES_SQL, docs, lines, table

W = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}]+')"
POST = f"post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({W.format('text')}) AS term FROM documents) GROUP BY 1, 2)"
ASK = f"ask AS (SELECT DISTINCT item_id, unnest({W.format('text')}) AS term FROM benchmark)"
KEYWORD = f"""{POST}, {ASK}, n AS (SELECT count(DISTINCT doc_id) AS n FROM post),
  idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, n GROUP BY term, n),
  kscore AS (SELECT item_id, doc_id, sum(tf * idf) AS score FROM post JOIN ask USING (term) JOIN idf USING (term) GROUP BY 1, 2),
  krank AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM kscore) WHERE rank <= 30)"""


def _keyword(spark: SparkSession, d: str, limit: int = 30) -> DataFrame:
    texts = table(spark, d, "documents")
    return rt.keyword_search_texts(spread(texts.select("doc_id", "text")), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text", limit)


@query("k05_postings", f"WITH {POST} SELECT * FROM post")
def k05(spark, d):
    return rt.postings(table(spark, d, "documents"), "doc_id", "text")


@query("k06_keyword_search", f"WITH {KEYWORD} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM krank")
def k06(spark, d):
    return _keyword(spark, d).withColumn("score", F.round("score", 6))


@query("k06_indexed_search")
def k06_indexed(spark, d):
    """The same hits from a persisted index that is built for it; tested against k06_keyword_search."""
    texts = table(spark, d, "documents").select("doc_id", "text")
    index = KeywordIndex(spark, work_folder(spark, "keyword-index"), "doc_id", blocks=blocks_of(texts))
    index.build(texts, "text")
    return index.search(table(spark, d, "benchmark"), "item_id", "text", 30, total=rt.searchable_count(texts, "text")).withColumn("score", F.round("score", 6))


VEC = "q AS (SELECT vec_id AS q_id, embedding AS qe FROM embeddings WHERE vec_id % 20 = 0)"
DENSE = f"""{VEC}, dscore AS (SELECT q_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])) AS score FROM embeddings, q),
  drank AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM dscore) WHERE rank <= 30)"""


def _dense(spark, d):
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("qe"))
    return rt.dense_search(v, asked, "vec_id", "embedding", "q_id", "qe", 30)


@query("k07_dense_search", f"WITH {DENSE} SELECT q_id, vec_id, round(score, 6) AS score, rank FROM drank")
def k07(spark, d):
    return _dense(spark, d).withColumn("score", F.round("score", 6))


#: The dense leg: a query's vector is the one with its number, a document's the one with its.
FUSED = f"""{KEYWORD}, qd AS (SELECT item_id, embedding AS qe FROM benchmark JOIN embeddings ON vec_id = item_id),
  vscore AS (SELECT item_id, vec_id AS doc_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])) AS score FROM embeddings, qd),
  vrank AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM vscore) WHERE rank <= 30),
  ls AS (SELECT item_id, doc_id, rank FROM krank UNION ALL SELECT item_id, doc_id, rank FROM vrank),
  fused AS (SELECT item_id, doc_id, sum(1.0 / (60 + rank)) AS fused, min(rank) AS best_rank FROM ls GROUP BY 1, 2),
  frank AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(fused, 12) DESC, best_rank, doc_id) AS fused_rank FROM fused)"""


def _fused(spark, d):
    v = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    asked = table(spark, d, "benchmark").select("item_id").join(v.select(F.col("doc_id").alias("item_id"), F.col("embedding").alias("qe")), "item_id")
    return rt.fuse([_keyword(spark, d), rt.dense_search(v, asked, "doc_id", "embedding", "item_id", "qe", 30)], "item_id", "doc_id")


@query("k10_rank_fusion", f"WITH {FUSED} SELECT item_id, doc_id, round(fused, 9) AS fused, best_rank, fused_rank FROM frank")
def k10(spark, d):
    return _fused(spark, d).withColumn("fused", F.round("fused", 9))


@query(
    "k13_hybrid_search",
    f"""WITH {FUSED}, {DOCS_SQL}, newest AS (SELECT name, max(edition_date) AS newest FROM docs GROUP BY 1),
  s AS (SELECT item_id, doc_id, name, label, fused + CASE WHEN edition_date = newest THEN 0.01 ELSE 0 END AS score, fused_rank FROM frank JOIN docs USING (doc_id) JOIN newest USING (name)),
  o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, fused_rank) AS rank FROM s),
  t AS (SELECT * FROM o WHERE rank <= 10),
  e AS (SELECT *, label IS NOT NULL AND (SELECT count(DISTINCT u.label) FROM t u WHERE u.item_id = t.item_id AND u.name = t.name) > 1 AS other FROM t),
  v AS (SELECT * FROM e WHERE doc_id IN (SELECT doc_id FROM docs WHERE NOT deleted AND search_state <> 'replaced'))
  SELECT item_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS rank,
    other AND count(*) OVER (PARTITION BY item_id, name) > CASE WHEN label IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY item_id, name, label) END AS other_editions FROM v""",
)
def k13(spark, d):
    """Keyword and dense search fused, ranked with the weight of latest editions, flagged, and cut to what is visible."""
    known = docs(spark, d)
    flagged = vs.refresh_latest(known.withColumn("active", F.lit(True))).select("doc_id", "name", "label", "is_latest_edition")
    ranked = rt.rerank(_fused(spark, d).join(flagged, "doc_id"), "item_id", None, F.col("is_latest_edition"), 0.01)
    kept = ranked.where("order <= 10").withColumnRenamed("order", "rank")
    shown = rt.visible_results(kept.withColumn("other_editions", rt.other_editions(kept, "item_id")), known, "item_id")
    return shown.select("item_id", "doc_id", F.round("score", 9).alias("score"), "rank", "other_editions")


@query("k02_terms", f"SELECT item_id, {W.format('text')} AS terms FROM benchmark")
def k02(spark, d):
    return table(spark, d, "benchmark").select("item_id", tx.terms(F.col("text")).alias("terms"))


NB = f"""{LINES_SQL}, tok AS (SELECT doc_id, pos, len({W.format('text')}) AS n FROM chunks),
  hit AS (SELECT doc_id, pos AS p FROM chunks),
  near AS (SELECT h.doc_id, h.p, t.pos, t.pos < p AS b, abs(t.pos - p) AS dist, n FROM hit h JOIN tok t ON t.doc_id = h.doc_id AND t.pos <> p),
  run AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, p ORDER BY dist, CASE WHEN b THEN 0 ELSE 1 END ROWS UNBOUNDED PRECEDING) AS used FROM near)"""


@query("n04_neighbours", f"WITH {NB} SELECT h.doc_id, h.p AS pos, coalesce(list(pos ORDER BY pos) FILTER (b AND used <= 80), []) AS before, coalesce(list(pos ORDER BY pos) FILTER (NOT b AND used <= 80), []) AS after FROM hit h LEFT JOIN run USING (doc_id, p) GROUP BY 1, 2")
def n04(spark, d):
    c = lines(spark, d).select("doc_id", F.lit("1").alias("version"), F.lit(True).alias("active"), F.lit("text").alias("kind"), F.col("pos").alias("order"), F.lit(None).cast("int").alias("split_index"), F.col("pos").cast("string").alias("chunk_key"), F.col("pos").alias("chunk_id"), F.size(tx.terms(F.col("text"))).alias("tokens"), F.array().cast("array<string>").alias("placeholder_ids"))
    hits = c.select(F.struct("doc_id", "chunk_id").alias("hit_id"), "doc_id", "version", F.array("chunk_id").alias("members"), F.lit(None).cast("int").alias("asset_order"), "placeholder_ids")
    return rt.neighbours(hits, c, 80).select("hit_id.doc_id", F.col("hit_id.chunk_id").alias("pos"), "before", "after")


@query("a01_latest_editions", f"WITH {DOCS_SQL} SELECT doc_id, name, CAST(edition_date AS VARCHAR) AS edition_date FROM docs WHERE edition_date = (SELECT max(edition_date) FROM docs b WHERE b.name = docs.name)")
def a01(spark, d):
    return cat.latest_ids(docs(spark, d)).select("doc_id", "name", F.col("edition_date").cast("string").alias("edition_date"))


@query("f01_scope", f"WITH {DOCS_SQL}, m AS (SELECT name, max(edition_date) AS x FROM docs WHERE searchable GROUP BY 1) SELECT doc_id FROM docs LEFT JOIN m USING (name) WHERE searchable AND (edition_date IS NULL OR edition_date = x)")
def f01(spark, d):
    r = vs.refresh_latest(docs(spark, d).withColumn("active", F.col("searchable")))
    c = F.col
    return r.where(rt.scope(c("active"), c("doc_id"), c("name"), c("label"), c("edition_date").isNotNull(), c("is_latest_edition"), "LATEST")).select("doc_id")


@query("f05_document_list", f"WITH {DOCS_SQL} SELECT doc_id, state, row_number() OVER (ORDER BY list_position(['uploaded', 'captioning', 'queued', 'indexing', 'completed', 'failed'], state), updated_at DESC, doc_id) AS place FROM docs WHERE NOT deleted AND edition_date IS NOT NULL AND state IN ('queued', 'failed', 'completed') ORDER BY place LIMIT 50")
def f05(spark, d):
    rows = docs(spark, d).where(cat.list_filter(["queued", "failed", "completed"], has_edition=True))
    order = cat.sort_documents(cat.state_order(F.col("state")), False)
    p = cat.page(rows, order, 1, 50)
    return p.select("doc_id", "state", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query("f06_latest_only_list", f"WITH {DOCS_SQL}, m AS (SELECT name, max(edition_date) AS x FROM docs WHERE searchable AND NOT deleted GROUP BY 1) SELECT doc_id FROM docs LEFT JOIN m USING (name) WHERE edition_date IS NULL OR (searchable AND edition_date = x)")
def f06(spark, d):
    return cat.latest_only(docs(spark, d)).select("doc_id")


@query("f07_visible", f"WITH {DOCS_SQL} SELECT doc_id FROM docs WHERE NOT deleted AND search_state <> 'replaced'")
def f07(spark, d):
    return cat.visible(docs(spark, d)).select("doc_id")


@query("f08_work_queue", f"WITH {DOCS_SQL} SELECT state, count(*) AS n FROM docs WHERE NOT deleted GROUP BY 1")
def f08(spark, d):
    return cat.work_queue(docs(spark, d))


@query("f10_name_prefix", f"WITH {DOCS_SQL} SELECT DISTINCT name FROM docs WHERE NOT deleted AND starts_with(name, 'src1') AND name > 'src10' ORDER BY name LIMIT 100")
def f10(spark, d):
    return cat.names_after(docs(spark, d), "src1", "src10")


@query("f12_same_edition", f"WITH {DOCS_SQL}, s AS (SELECT name, label, count(*) AS c, min(doc_id) AS first_id FROM docs WHERE NOT deleted AND search_state <> 'replaced' GROUP BY 1, 2) SELECT doc_id, coalesce(c, 0) - CASE WHEN NOT deleted AND search_state <> 'replaced' THEN 1 ELSE 0 END AS n_others, first_id FROM docs LEFT JOIN s ON docs.name = s.name AND docs.label IS NOT DISTINCT FROM s.label")
def f12(spark, d):
    return cat.edition_counts(docs(spark, d))


@query("j08_sibling_editions", f"WITH {DOCS_SQL}, e AS (SELECT DISTINCT d.doc_id, v.label, v.edition_date AS x FROM docs d JOIN docs v USING (name) WHERE v.edition_date IS NOT NULL AND NOT v.deleted AND v.search_state <> 'replaced' UNION SELECT doc_id, label, edition_date FROM docs WHERE edition_date IS NOT NULL), s AS (SELECT doc_id, string_agg(label || '@' || x, ',' ORDER BY x DESC, label) AS editions FROM e GROUP BY 1) SELECT doc_id, editions FROM docs LEFT JOIN s USING (doc_id)")
def j08(spark, d):
    out = cat.siblings(docs(spark, d))
    return out.select("doc_id", F.array_join(F.transform("editions", lambda e: F.concat(e["label"], F.lit("@"), e["edition_date"].cast("string"))), ",").alias("editions"))


LOGS = "logs AS (SELECT event_id AS log_id, ts AS occurred_at, event_type AS kind, user_id AS doc_id, CASE WHEN event_id % 3 = 0 THEN 'failure' ELSE 'success' END AS outcome FROM events)"


def _logs(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("log_id"), F.col("ts").alias("occurred_at"), F.col("event_type").alias("kind"), F.col("user_id").alias("doc_id"), F.when(F.col("event_id") % 3 == 0, "failure").otherwise("success").alias("outcome"))


@query("f09_log_page", f"WITH {LOGS} SELECT log_id, kind, row_number() OVER (ORDER BY kind, occurred_at DESC, log_id DESC) AS place FROM logs WHERE outcome = 'failure' ORDER BY place LIMIT 100")
def f09(spark, d):
    order = cat.sort_logs("kind", False)
    p = cat.page(_logs(spark, d).where(cat.log_filter(outcome="failure")), order, 1, 100)
    return p.select("log_id", "kind", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query("j11_deleted_flag", f"WITH {LOGS} SELECT log_id, doc_id IN (SELECT doc_id FROM logs WHERE kind = (SELECT min(kind) FROM logs)) AS document_deleted FROM logs")
def j11(spark, d):
    rows = _logs(spark, d)
    first = rows.agg(F.min("kind")).scalar()
    return cat.with_deleted_flag(rows, rows.withColumn("kind", F.when(F.col("kind") == first, "delete").otherwise(F.col("kind")))).select("log_id", "document_deleted")


@query("x19_korean_day", f"WITH {LOGS} SELECT CAST(CAST(occurred_at + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS day, count(*) AS n FROM logs GROUP BY 1")
def x19(spark, d):
    return _logs(spark, d).groupBy(F.date_format(F.col("occurred_at") + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("a04_latest_order", "SELECT o_custkey AS doc_id, max(o_orderkey) AS job_id FROM orders GROUP BY 1")
def a04(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("job_id"), F.col("o_orderkey").alias("accepted_order"))
    return vs.latest_job(jobs).select("doc_id", "job_id")


@query("j03_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def j03(spark, d):
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("query"), F.col("c_custkey").alias("rank"), F.col("c_mktsegment").alias("name"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("other_editions"))
    known = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("doc_id"), F.lit(False).alias("deleted"), F.lit("searchable").alias("search_state"))
    return rt.visible_results(asked.withColumn("query", F.col("doc_id")), known, "query").select(F.col("doc_id").alias("c_custkey"))


@query("j12_anti_join", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def j12(spark, d):
    """Records whose set is gone are deleted; what stays."""
    records = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("golden_set_id"))
    return ev.orphans_removed(records, table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("golden_set_id"))).select("o_orderkey")


@query("j09_replaced_editions", f"WITH {DOCS_SQL} SELECT DISTINCT a.doc_id, CASE WHEN a.state IN ('uploaded', 'captioning', 'queued', 'indexing') THEN 'failed' ELSE a.state END AS state FROM docs a JOIN (SELECT name, label, max(updated_at) AS updated_at FROM docs GROUP BY 1, 2) s ON a.name = s.name AND a.label IS NOT DISTINCT FROM s.label AND a.updated_at < s.updated_at WHERE NOT a.deleted AND a.search_state <> 'replaced'")
def j09(spark, d):
    x = docs(spark, d).withColumn("entered_at", F.col("updated_at"))
    return vs.replaced_editions(x, x).select("doc_id", "state")


@query("o04_golden_sort", "SELECT vec_id, label AS sorted_by FROM (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE label END AS label FROM embeddings) ORDER BY label DESC NULLS LAST, vec_id DESC LIMIT 100")
def o04(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 != 0, F.col("label")).alias("sorted_by"), F.col("vec_id").alias("created_at"), F.col("vec_id").alias("golden_set_id"))
    return cat.page(rows, cat.sort_golden(F.col("sorted_by"), True), 1, 100).select("vec_id", "sorted_by")


EVAL = rf"""{KEYWORD}, strip_ AS (SELECT doc_id, regexp_replace(text, '\s', '', 'g') AS body FROM documents),
  span AS (SELECT item_id, regexp_replace(text, '\s', '', 'g') AS span FROM benchmark),
  r AS (SELECT item_id, min(CASE WHEN contains(body, span) THEN rank END) AS rank FROM krank JOIN span USING (item_id) JOIN strip_ USING (doc_id) WHERE rank <= 10 GROUP BY 1)"""


@query("e04_hit_metrics", f"WITH {EVAL} SELECT span.item_id AS case_id, coalesce(rank, -1) AS rank, coalesce(rank <= 1, false) AS hit_at_1, coalesce(rank <= 3, false) AS hit_at_3, coalesce(rank <= 5, false) AS hit_at_5, coalesce(rank <= 10, false) AS hit_at_n, round(coalesce(1.0 / rank, 0), 6) AS reciprocal_rank FROM span LEFT JOIN r USING (item_id)")
def e04(spark, d):
    hits = _keyword(spark, d, 10).join(table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("name")), "doc_id")
    hits = hits.select(F.col("item_id").alias("case_id"), "rank", "doc_id", "text", F.lit("any").alias("name"))
    cases = table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.lit(False).alias("edition_only"), F.lit(0).alias("doc_id"), F.lit("any").alias("name"), F.col("text").alias("answer_span"))
    return ev.metrics(hits, cases, ev.body([F.array("text")])).drop("coverage").withColumns({"rank": F.coalesce("rank", F.lit(-1)), "reciprocal_rank": F.round("reciprocal_rank", 6)})


@query(
    "e06_evaluation_run",
    rf"""WITH {LINES_SQL}, post AS (SELECT doc_id, pos, term, count(*) AS tf FROM (SELECT doc_id, pos, unnest({W.format('text')}) AS term FROM chunks) GROUP BY 1, 2, 3),
  {ASK}, n AS (SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, pos FROM post)),
  idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, n WHERE term IN (SELECT term FROM ask) GROUP BY term, n),
  kscore AS (SELECT item_id, doc_id, pos, sum(tf * idf) AS score FROM post JOIN ask USING (term) JOIN idf USING (term) GROUP BY 1, 2, 3),
  krank AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id, pos) AS rank FROM kscore) WHERE rank <= 10),
  tok AS (SELECT doc_id, pos, text, len({W.format('text')}) AS n FROM chunks WHERE doc_id IN (SELECT doc_id FROM krank)),
  hit AS (SELECT DISTINCT doc_id, pos AS p FROM krank),
  near AS (SELECT h.doc_id, h.p, t.pos, t.pos < p AS b, abs(t.pos - p) AS dist, n, text FROM hit h JOIN tok t ON t.doc_id = h.doc_id AND t.pos <> p),
  run AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, p ORDER BY dist, CASE WHEN b THEN 0 ELSE 1 END ROWS UNBOUNDED PRECEDING) AS used FROM near),
  side AS (SELECT doc_id, p, string_agg(text, '' ORDER BY pos) FILTER (b) AS before, string_agg(text, '' ORDER BY pos) FILTER (NOT b) AS after FROM run WHERE used <= 80 GROUP BY 1, 2),
  bodies AS (SELECT t.doc_id, t.pos, regexp_replace(t.text, '\s', '', 'g') AS base, regexp_replace(coalesce(before, '') || t.text || coalesce(after, ''), '\s', '', 'g') AS expanded
    FROM hit JOIN tok t ON t.doc_id = hit.doc_id AND t.pos = hit.p LEFT JOIN side ON side.doc_id = hit.doc_id AND side.p = hit.p),
  span AS (SELECT item_id, regexp_replace(text, '\s', '', 'g') AS span FROM benchmark),
  r AS (SELECT item_id, min(CASE WHEN contains(base, span) THEN rank END) AS b, min(CASE WHEN contains(expanded, span) THEN rank END) AS x FROM krank JOIN span USING (item_id) JOIN bodies USING (doc_id, pos) GROUP BY 1)
  SELECT item_id AS case_id, coalesce(b, -1) AS base_rank, coalesce(x, -1) AS expanded_rank, CASE WHEN x IS NULL THEN 'miss' ELSE 'hit' END AS outcome FROM span LEFT JOIN r USING (item_id)""",
)
def e06(spark, d):
    """Benchmark texts as golden sets: keyword search of lines, the lines found with their neighbours, and the outcome."""
    c = lines(spark, d).withColumn("chunk_id", F.struct("doc_id", "pos"))
    asked = table(spark, d, "benchmark")
    found = rt.keyword_search_texts(c, asked, "chunk_id", "text", "item_id", "text", 10).cache()
    string = lambda name: F.lit(None).cast("string").alias(name)
    chunks = c.select(
        "chunk_id", "doc_id", F.lit("1").alias("version"), F.lit("any").alias("name"), string("label"), F.lit(True).alias("active"), F.lit("text").alias("kind"), F.col("pos").alias("order"), string("split_group"),
        F.lit(None).cast("int").alias("split_index"), F.col("pos").cast("string").alias("chunk_key"), "text", F.array().cast("array<string>").alias("heading_path"), F.size(tx.terms(F.col("text"))).alias("tokens"), F.array().cast("array<string>").alias("placeholder_ids"), F.lit(False).alias("is_latest_edition"),
    )
    # both are the few rows of the hits, which every metric reads again
    hits = search.results([found], chunks, "item_id", 10, 80).withColumnRenamed("item_id", "case_id").cache()
    cases = asked.select(F.col("item_id").alias("case_id"), F.lit(False).alias("edition_only"), F.lit(0).alias("doc_id"), F.lit("any").alias("name"), F.col("text").alias("answer_span"))
    got = ev.evaluate(cases, hits)
    place = lambda kind: F.coalesce(F.col(f"{kind}.rank"), F.lit(-1)).alias(f"{kind}_rank")
    return got.select("case_id", place("base"), place("expanded"), "outcome")


@query("e05_coverage")
def e05(spark, d):
    hits = _keyword(spark, d, 3).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select(F.col("item_id").alias("case_id"), "rank", "doc_id", "text", F.lit("any").alias("name"))
    cases = table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.lit(False).alias("edition_only"), F.lit(0).alias("doc_id"), F.lit("any").alias("name"), F.col("text").alias("answer_span"))
    return ev.metrics(hits, cases, ev.body([F.array("text")])).select("case_id", "coverage")


@query("t01_event_cursor", "SELECT user_id AS doc_id, event_id AS arrival, (event_id * 7919) % 1009 AS sequence FROM (SELECT *, max((event_id * 7919) % 1009) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) WHERE b IS NULL OR (event_id * 7919) % 1009 > b")
def t01(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("arrival"), (F.col("event_id") * 7919 % 1009).alias("sequence"), F.lit("running").alias("job_state"))
    return st.accepted(e).select("doc_id", "arrival", "sequence")


@query("t05_sessions", "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 300 SECOND THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), h AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n, min(ts) AS start FROM h GROUP BY user_id, k")
def t05(spark, d):
    return st.sessions(table(spark, d, "events"), "user_id", "ts").select("user_id", "n", "start")


@query("m21_index_order", "SELECT l_orderkey AS doc_id, CAST(max(l_linenumber) AS VARCHAR) AS version FROM lineitem GROUP BY 1")
def m21(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("string").alias("version"), F.lit(True).alias("active"))
    return vs.string_version(v)
