"""Joins, aggregates, views and whole-table changes over the driver's tables, each beside its SQL.

Stand-ins: jobs and index records are orders, assets and chunks are lineitem, logs are events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import assets as at
from ..operators import catalog as cat
from ..operators import chunking as ck
from ..operators import evaluation as ev
from ..operators import retrieval as rt
from ..operators import versions as vs
from ..sources.store import parts_of
from ..streaming import events as st
from .base import query
from .corpus import DOCS_SQL, docs, table

c = F.col
FULL = f"""{DOCS_SQL}, cat_ AS (SELECT *, CAST(1 + doc_id % 12 AS VARCHAR) AS latest_version, CASE WHEN doc_id % 4 = 0 THEN CAST(1 + doc_id % 12 AS VARCHAR) END AS queued_version, searchable AS active FROM docs),
  ver AS (SELECT doc_id, CAST(1 + doc_id % 12 AS VARCHAR) AS version, 'f' || doc_id AS file_name, 'r' || doc_id AS result, 'e' || doc_id AS failure FROM docs WHERE doc_id % 9 <> 0)"""


def full(spark: SparkSession, d: str) -> DataFrame:
    v = (1 + c("doc_id") % 12).cast("string")
    return docs(spark, d).withColumns({"latest_version": v, "queued_version": F.when(c("doc_id") % 4 == 0, v), "active": c("searchable"), "entered_at": c("updated_at")})


def vers(spark: SparkSession, d: str) -> DataFrame:
    name = lambda p: F.concat(F.lit(p), c("doc_id").cast("string"))
    return table(spark, d, "documents").where("doc_id % 9 <> 0").select("doc_id", (1 + c("doc_id") % 12).cast("string").alias("version"), name("f").alias("file_name"), name("r").alias("result"), name("e").alias("failure"))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    o = c("o_orderkey")
    return table(spark, d, "orders").select(c("o_custkey").alias("doc_id"), o.alias("job_id"), o.alias("accepted_order"), F.element_at(F.array(*map(F.lit, ["queued", "running", "succeeded", "failed"])), (o % 4 + 1).cast("int")).alias("state"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("failure_code"), F.lit(None).cast("bigint").alias("chunk_count"), (o % 3 == 0).alias("prepared"))


JOBS = "jobs AS (SELECT o_custkey AS doc_id, o_orderkey AS job_id, o_orderkey AS accepted_order, ['queued', 'running', 'succeeded', 'failed'][o_orderkey % 4 + 1] AS state, o_orderkey % 3 = 0 AS prepared FROM orders)"
ASSETS = """assets AS (SELECT l_orderkey AS doc_id, '1' AS version, 't' || l_linenumber AS placeholder_id, CASE WHEN l_returnflag = 'N' THEN 'image' ELSE 'table' END AS kind, l_linenumber AS ord,
  CASE WHEN l_linenumber > 4 THEN 't1' END AS table_id, CASE WHEN l_linestatus = 'O' THEN 'pending' ELSE 'done' END AS hint_status, CASE WHEN l_quantity > 25 THEN 'h' || l_partkey END AS hint, 'd' || l_suppkey AS description,
  l_linenumber = 2 AS is_temporary, 'p' || l_partkey % 3 AS path FROM lineitem)"""


def assets(spark: SparkSession, d: str) -> DataFrame:
    t = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    n = c("l_linenumber")
    return table(spark, d, "lineitem").select(
        c("l_orderkey").alias("doc_id"), F.lit("1").alias("version"), t("t", n).alias("placeholder_id"), F.when(c("l_returnflag") == "N", "image").otherwise("table").alias("kind"), n.alias("order"),
        F.when(n > 4, "t1").alias("table_id"), F.when(c("l_linestatus") == "O", "pending").otherwise("done").alias("hint_status"), F.when(c("l_quantity") > 25, t("h", c("l_partkey"))).alias("hint"), t("d", c("l_suppkey")).alias("description"),
        (n == 2).alias("is_temporary"), t("p", c("l_partkey") % 3).alias("path"),
    )


RECORDS = "rec AS (SELECT o_custkey AS golden_set_id, o_orderkey AS record_id, o_orderdate AS started_at, CASE o_orderstatus WHEN 'O' THEN 'hit' WHEN 'F' THEN 'miss' ELSE 'evaluating' END AS outcome FROM orders)"


def records(spark: SparkSession, d: str) -> DataFrame:
    s = c("o_orderstatus")
    return table(spark, d, "orders").select(c("o_custkey").alias("golden_set_id"), c("o_orderkey").alias("record_id"), c("o_orderdate").alias("started_at"), F.when(s == "O", "hit").when(s == "F", "miss").otherwise("evaluating").alias("outcome"))


def same(text: str, key: Column) -> Column:
    """One text for all that has a key; a literal would leave the columns that a join deals rows by."""
    return F.when(key.isNotNull(), text)


# Scans and sinks


@query("s03_editions_of_name", f"WITH {FULL} SELECT doc_id, label FROM cat_ WHERE active AND name = 'src1'")
def s03(spark, d):
    return full(spark, d).where("active and name = 'src1'").groupBy("doc_id").agg(F.max("label").alias("label"))


@query("s05_upsert", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def s05(spark, d):
    x = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = x.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("new"))
    return vs.upsert(x.where("c_custkey % 2 = 0"), new.union(new), ["c_custkey"])


# Filters and views


@query("f08_queue_filters", f"WITH {FULL}, v AS (SELECT * FROM cat_ WHERE NOT deleted AND search_state <> 'replaced') SELECT doc_id, 'queued' AS queue FROM v WHERE queued_version IS NOT NULL UNION ALL SELECT doc_id, 'reconcile' FROM v WHERE queued_version IS NULL AND state IN ('queued', 'indexing')")
def f08(spark, d):
    x = full(spark, d)
    return x.where(cat.in_queue()).select("doc_id", F.lit("queued").alias("queue")).union(x.where(cat.to_reconcile()).select("doc_id", F.lit("reconcile")))


@query("f11_pending_hints", f"WITH {ASSETS} SELECT doc_id, placeholder_id FROM assets WHERE hint_status = 'pending' AND kind = 'image' AND table_id IS NULL")
def f11(spark, d):
    return at.pending_hints(assets(spark, d), "image").select("doc_id", "placeholder_id")


@query("f13_golden_hits", f"WITH {RECORDS}, l AS (SELECT *, row_number() OVER (PARTITION BY golden_set_id ORDER BY started_at DESC, record_id DESC) AS r FROM rec) SELECT golden_set_id, record_id FROM l JOIN customer ON c_custkey = golden_set_id WHERE r = 1 AND outcome = 'hit'")
def f13(spark, d):
    sets = table(spark, d, "customer").select(c("c_custkey").alias("golden_set_id"))
    return ev.golden_list(sets, records(spark, d), "hit").select("golden_set_id", "record_id")


RUN = "run AS (SELECT doc_id, 'chunking' AS stage FROM docs WHERE doc_id % 2 = 1)"


def running(spark, d):
    return table(spark, d, "documents").where("doc_id % 2 = 1").select("doc_id", F.lit("running").alias("state"), F.lit("chunking").alias("stage"))


@query("p01_summary_view", f"WITH {FULL}, {RUN} SELECT doc_id, name, state, CASE WHEN state = 'indexing' THEN stage END AS stage, CASE WHEN state = 'failed' THEN failure END AS failure, CASE WHEN state = 'queued' THEN queued_version IS NOT NULL END AS queued FROM cat_ LEFT JOIN ver USING (doc_id) LEFT JOIN run USING (doc_id)")
def p01(spark, d):
    return cat.summary_view(full(spark, d), vers(spark, d), running(spark, d))


@query("p02_detail_view", f"WITH {FULL}, {RUN} SELECT doc_id, name, state, CASE WHEN state = 'indexing' THEN stage END AS stage, CASE WHEN state = 'failed' THEN failure END AS failure, CASE WHEN state = 'queued' THEN queued_version IS NOT NULL END AS queued, file_name, CASE WHEN state = 'completed' THEN result END AS result FROM cat_ JOIN ver USING (doc_id) LEFT JOIN run USING (doc_id)")
def p02(spark, d):
    return cat.detail_view(full(spark, d), vers(spark, d), running(spark, d))


@query("p03_asset_view", f"WITH {ASSETS} SELECT doc_id, version, placeholder_id, kind, CASE WHEN hint_status <> 'pending' THEN coalesce(hint, description) END AS text, hint_status <> 'pending' AND is_temporary AS is_temporary FROM assets")
def p03(spark, d):
    return at.asset_view(assets(spark, d))


@query("p04_hints_for_index", f"WITH {ASSETS} SELECT doc_id, placeholder_id, coalesce(hint, description) AS sentence FROM assets WHERE table_id IS NULL")
def p04(spark, d):
    return at.hints_for_index(assets(spark, d))


@query("p05_log_view", "SELECT event_id AS log_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS occurred_at, event_type AS kind, user_id AS doc_id, event_type = (SELECT min(event_type) FROM events) AS document_deleted FROM events")
def p05(spark, d):
    e = table(spark, d, "events")
    low = F.broadcast(e.agg(F.min("event_type").alias("low")))
    rows = e.join(low).select(c("event_id").alias("log_id"), c("ts").alias("occurred_at"), c("event_type").alias("kind"), c("user_id").alias("doc_id"), F.lit("n").alias("name"), F.lit(None).cast("string").alias("edition_label"), (c("event_type") == c("low")).alias("document_deleted"), F.lit("success").alias("outcome"), F.lit("").alias("description"))
    return cat.log_view(rows).select("log_id", "occurred_at", "kind", "document.doc_id", "document_deleted")


# Joins


@query("j02_chunks_of_hits", "SELECT l_orderkey AS doc_id, list(CAST(l_linenumber AS VARCHAR) ORDER BY l_linenumber) AS keys FROM lineitem WHERE l_linenumber <> 3 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45 AND l_linenumber <> 3) GROUP BY 1")
def j02(spark, d):
    """Hits on large lines of an order bring all active lines of the order, as one split group each."""
    scan = table(spark, d, "lineitem")
    chunks = scan.select(c("l_orderkey").alias("doc_id"), same("1", c("l_orderkey")).alias("version"), (c("l_linenumber") != 3).alias("active"), same("g", c("l_orderkey")).alias("split_group"), c("l_linenumber").alias("split_index"), c("l_linenumber").cast("string").alias("chunk_key"), c("l_linenumber").alias("key"), c("l_returnflag").alias("text"), F.array("l_linestatus").alias("heading_path"), "l_quantity")
    ranked = chunks.where("active and l_quantity > 45").select(c("doc_id").alias("q"), "doc_id", "version", "split_group", "key", F.lit(1.0).alias("score"), c("key").alias("order"))
    groups = rt.group_fragments(ranked.repartition(parts_of(scan), "q"), "q", "key", 1)
    return rt.complete_fragments(groups, chunks, "q", "key", parts_of(scan)).select("doc_id", F.transform("chunks", lambda x: x["chunk_key"]).alias("keys"))


@query("j05_answer_reference", f"WITH {DOCS_SQL} SELECT c_custkey, coalesce(name, '알 수 없는 문서') AS answer_name, label AS answer_label FROM customer LEFT JOIN (SELECT * FROM docs WHERE NOT deleted) ON doc_id = c_custkey")
def j05(spark, d):
    return cat.answer_view(table(spark, d, "customer").select("c_custkey", c("c_custkey").alias("doc_id")), docs(spark, d).where("not deleted")).select("c_custkey", "answer_name", "answer_label")


@query("j10_searchable_jobs", f"WITH {JOBS} SELECT c_custkey AS doc_id, state AS job_state FROM customer JOIN jobs ON job_id = c_custkey")
def j10(spark, d):
    x = table(spark, d, "customer").select(c("c_custkey").alias("doc_id"), c("c_custkey").alias("searchable_job_id"))
    return vs.searchable_jobs(x, jobs(spark, d)).select("doc_id", "job_state")


@query("j13_keep_ids", "SELECT l_orderkey AS doc_id, l_orderkey * 10 + l_linenumber AS chunk_id FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2 AND l_orderkey % 2 = 0) OR l_linenumber = 2")
def j13(spark, d):
    x = table(spark, d, "lineitem").select(c("l_orderkey").alias("doc_id"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("chunk_id"), "l_linenumber")
    return vs.keep_ids(x, x.where("l_linenumber = 2 and doc_id % 2 = 0")).select("doc_id", "chunk_id")


@query("j14_index_text", "SELECT item_id AS chunk_id, 'A > B' || chr(10) || 'T' || chr(10) || chr(10) || 's' || item_id || ' ' || replace(text, chr(10), ' ') AS index_text FROM benchmark")
def j14(spark, d):
    b = table(spark, d, "benchmark")
    text = F.concat(F.lit("[[asset:table:t1 | x]] "), F.replace("text", F.lit("\n"), F.lit(" ")))
    chunks = b.select(c("item_id").alias("chunk_id"), c("item_id").alias("doc_id"), F.lit("text").alias("kind"), F.array(F.lit("A"), F.lit("B")).alias("heading_path"), F.lit("T").alias("title"), text.alias("text"), F.array(F.lit("t1")).alias("placeholder_ids"))
    return ck.index_text(chunks, b.select(c("item_id").alias("doc_id"), F.lit("t1").alias("placeholder_id"), F.concat(F.lit("s"), c("item_id").cast("string")).alias("sentence")))


@query("j15_restore", "SELECT item_id AS doc_id, 's' || item_id || ' [[asset:image:t1 | y]] [[asset:table:t9 | z]] ' || text AS text FROM benchmark")
def j15(spark, d):
    b = table(spark, d, "benchmark")
    rows = b.select(c("item_id").alias("doc_id"), F.concat(F.lit("[[asset:table:t1 | x]] [[asset:image:t1 | y]] [[asset:table:t9 | z]] "), c("text")).alias("text"))
    return at.restore(rows, b.select(c("item_id").alias("doc_id"), F.lit("t1").alias("placeholder_id"), F.lit("table").alias("kind"), F.concat(F.lit("s"), c("item_id").cast("string")).alias("source"))).select("doc_id", "text")


@query("j16_nested_image_paths", "SELECT item_id AS doc_id, '<img src=u' || item_id || '> <img src=v> ' || text AS source FROM benchmark")
def j16(spark, d):
    b = table(spark, d, "benchmark").select(c("item_id").alias("doc_id"), "text")
    tables = b.select("doc_id", F.lit("t1").alias("placeholder_id"), F.concat(F.lit("<img src=aa> <img src=bb> "), c("text")).alias("source"))
    spot = lambda a, e, u: b.select("doc_id", F.lit("t1").alias("table_id"), F.lit(a).alias("start"), F.lit(e).alias("end"), u.alias("url"))
    images = spot(9, 11, F.concat(F.lit("u"), c("doc_id").cast("string"))).union(spot(22, 24, F.lit("v"))).union(spot(10, 12, F.lit("overlap"))).union(spot(5, 1 << 30, F.lit("beyond")))
    return at.rewrite_paths(tables, images).select("doc_id", "source")


@query("j17_upload_pairs", "SELECT n_name AS file_name, CASE WHEN n_nationkey % 5 = 0 THEN 'duplicate_file' WHEN n_nationkey % 3 = 0 THEN 'no_metadata' WHEN n_nationkey % 2 = 0 THEN 'no_file' END AS fault FROM nation")
def j17(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", c("n_name").alias("file_name"))
    files = n.where("n_nationkey % 5 = 0 or n_nationkey % 3 = 0 or n_nationkey % 2 = 1")
    return at.match_uploads(files.union(n.where("n_nationkey % 5 = 0")), n.where("n_nationkey % 5 = 0 or n_nationkey % 3 <> 0"))


@query("j18_image_files", "SELECT n_nationkey AS doc_id, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS file_key FROM nation")
def j18(spark, d):
    n = table(spark, d, "nation")
    name = F.concat(F.lit("a b"), c("n_nationkey").cast("string"), F.lit(".png"))
    images = n.select(c("n_nationkey").alias("doc_id"), F.lit("i1").alias("placeholder_id"), F.concat(F.lit("img/"), F.when(c("n_nationkey") % 4 == 0, name).otherwise(F.replace(name, F.lit(" "), F.lit("%20"))), F.lit("?v=1")).alias("path"))
    return at.match_images(images, n.where("n_nationkey % 2 = 0").select(name.alias("file_name"), c("n_nationkey").alias("file_key"))).select("doc_id", "file_key")


@query("j20_request_order", "SELECT o_orderkey AS pos, o_custkey AS doc_id, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = o_custkey")
def j20(spark, d):
    ids = table(spark, d, "orders").select(c("o_orderkey").alias("pos"), c("o_custkey").alias("doc_id"))
    return cat.in_request_order(ids, table(spark, d, "customer").where("c_custkey % 2 = 0").select(c("c_custkey").alias("doc_id"), "c_name")).select("pos", "doc_id", "c_name")


# Retrieval

HITS = "hits AS (SELECT l_orderkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank, l_partkey AS doc_id, l_quantity AS s FROM lineitem)"


def hits(spark, d):
    scan = table(spark, d, "lineitem")
    rows = scan.select(c("l_orderkey").alias("q"), "l_linenumber", c("l_partkey").alias("doc_id"), "l_suppkey", "l_extendedprice", c("l_quantity").alias("s"))
    place = F.row_number().over(Window.partitionBy("q").orderBy("l_linenumber", "doc_id", "l_suppkey", "l_extendedprice"))
    return rows.repartition(parts_of(scan), "q").select("q", place.alias("rank"), "doc_id", "s")


@query("k09_rank_map", f"WITH {HITS} SELECT q, doc_id, min(rank) AS rank FROM hits WHERE doc_id % 3 > 0 GROUP BY 1, 2")
def k09(spark, d):
    return rt.rank_map(hits(spark, d).withColumn("active", c("doc_id") % 3 > 0), "q", "doc_id", "active")


@query("k11_rerank", f"WITH {HITS}, b AS (SELECT *, CASE WHEN q % 2 = 0 THEN s ELSE 1.0 / rank END + CASE WHEN doc_id % 5 = 0 THEN 0.25 ELSE 0 END AS score FROM hits) SELECT q, rank, round(score, 9) AS score, row_number() OVER (PARTITION BY q ORDER BY score DESC, rank) AS \"order\" FROM b")
def k11(spark, d):
    x = hits(spark, d).withColumns({"fused": 1.0 / c("rank"), "fused_rank": c("rank")})
    model = F.when((c("q") % 2 == 1) & (c("rank") == 1), float("nan")).otherwise(c("s"))
    return rt.rerank(x, "q", model, c("doc_id") % 5 == 0, 0.25).select("q", "rank", F.round("score", 9).alias("score"), "order")


GROUPS = f"{HITS}, g AS (SELECT q, CASE WHEN rank > 2 THEN 'g' ELSE 'k' || rank END AS grp, min(rank) AS ord, max(s) AS score, count(*) AS n FROM hits GROUP BY 1, 2)"


def groups(spark, d):
    x = hits(spark, d).withColumns({"score": c("s"), "order": c("rank"), "split_group": F.when(c("rank") > 2, "g"), "key": c("rank"), "doc_id": c("q"), "version": same("1", c("q"))})
    return rt.group_fragments(x, "q", "key", 2)


@query("k14_fragment_groups", f"WITH {GROUPS}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY ord) AS rank FROM g) SELECT q, rank, score, n FROM r WHERE rank <= 2")
def k14(spark, d):
    return groups(spark, d).select("q", "rank", "score", F.size("members").alias("n"))


@query("k15_completed_fragments", f"WITH {GROUPS}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY ord) AS rank FROM g) SELECT q, rank, 'h' || ord AS first_path, n FROM r WHERE rank <= 2")
def k15(spark, d):
    x = hits(spark, d).select(c("q").alias("doc_id"), same("1", c("q")).alias("version"), F.lit(True).alias("active"), F.when(c("rank") > 2, "g").alias("split_group"), c("rank").alias("split_index"), c("rank").cast("string").alias("chunk_key"), c("rank").alias("key"), F.array(F.concat(F.lit("h"), c("rank").cast("string"))).alias("heading_path"), F.lit("t").alias("text"), F.lit("text").alias("kind"), F.array().cast("array<string>").alias("placeholder_ids"))
    out = rt.complete_fragments(groups(spark, d), x, "q", "key", parts_of(table(spark, d, "lineitem")))
    return out.select("q", "rank", F.array_join("heading_path", "").alias("first_path"), F.size("chunks").alias("n"))


@query("k18_visible_results", f"""WITH {DOCS_SQL}, {HITS}, h AS (SELECT q, rank, doc_id, name, label FROM hits JOIN docs USING (doc_id) WHERE NOT deleted AND search_state <> 'replaced')
  SELECT q, doc_id, row_number() OVER (PARTITION BY q ORDER BY rank) AS rank, EXISTS (SELECT 1 FROM h o WHERE o.q = h.q AND o.name = h.name AND o.rank <> h.rank AND (h.label IS NULL OR o.label IS NULL OR o.label <> h.label)) AS other_editions FROM h""")
def k18(spark, d):
    x = hits(spark, d).join(docs(spark, d).select("doc_id", "name", "label"), "doc_id").withColumn("other_editions", F.lit(True))
    return rt.visible_results(x, docs(spark, d), "q").select("q", "doc_id", "rank", "other_editions")


@query("k20_name_scope", f"WITH {DOCS_SQL} SELECT doc_id FROM docs WHERE NOT deleted AND search_state <> 'replaced' AND name IN ('src1', 'src2')")
def k20(spark, d):
    return cat.names_in_scope(docs(spark, d), spark.createDataFrame([(" src1 ",), ("src2",), ("src2",)], "name string"))


@query("n01_body_sequence", "SELECT l_orderkey AS doc_id, l_linenumber AS chunk, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_linenumber) AS pos FROM lineitem WHERE l_returnflag <> 'R'")
def n01(spark, d):
    x = table(spark, d, "lineitem").select(c("l_orderkey").alias("doc_id"), F.lit("1").alias("version"), (c("l_returnflag") != "R").alias("active"), F.lit("text").alias("kind"), c("l_suppkey").alias("order"), F.lit(None).cast("int").alias("split_index"), c("l_linenumber").cast("string").alias("chunk_key"), c("l_linenumber").alias("chunk"))
    return rt.body_sequence(x).select("doc_id", "chunk", "pos")


@query("o09_document_order", "SELECT l_orderkey AS doc_id, l_linenumber AS chunk, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber // 3, l_linenumber) AS place FROM lineitem")
def o09(spark, d):
    x = table(spark, d, "lineitem").select(c("l_orderkey").alias("doc_id"), F.lit("1").alias("version"), F.lit("text").alias("kind"), F.floor(c("l_linenumber") / 3).alias("order"), F.lit(None).cast("int").alias("split_index"), c("l_linenumber").cast("string").alias("chunk_key"), F.array().cast("array<string>").alias("placeholder_ids"), c("l_linenumber").alias("chunk"))
    return rt.document_order(x).select("doc_id", "chunk", "place")


# Aggregates


@query("a03_latest_records", f"WITH {RECORDS} SELECT golden_set_id, record_id, outcome FROM (SELECT *, row_number() OVER (PARTITION BY golden_set_id ORDER BY started_at DESC, record_id DESC) AS r FROM rec) WHERE r = 1")
def a03(spark, d):
    return ev.latest_records(records(spark, d)).select("golden_set_id", "record_id", "outcome")


ROLL = ", ".join(f"coalesce(avg(CASE WHEN o_orderstatus IN ('O', 'F') THEN CAST({e} AS DOUBLE) END), 0) AS {k}_{m}" for k, x in (("base", "o_orderkey % 7"), ("expanded", "o_orderkey % 4")) for m, e in [*((f"hit_at_{i}", f"CAST({x} < {i} AS INTEGER)") for i in (1, 3, 5)), ("hit_at_n", f"CAST({x} < 6 AS INTEGER)"), ("mrr", f"1.0 / (1 + {x})")])


@query("a05_roll_up", f"SELECT * REPLACE (round(base_mrr, 6) AS base_mrr, round(expanded_mrr, 6) AS expanded_mrr) FROM (SELECT count(*) AS count, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS evaluating, {ROLL} FROM orders)")
def a05(spark, d):
    m = lambda x: F.struct(*[(x < i).alias(f"hit_at_{i}") for i in (1, 3, 5)], (x < 6).alias("hit_at_n"), (1.0 / (1 + x)).alias("reciprocal_rank"))
    x = table(spark, d, "orders").select(F.when(c("o_orderstatus") == "O", "hit").when(c("o_orderstatus") == "F", "miss").otherwise("evaluating").alias("outcome"), m(c("o_orderkey") % 7).alias("base"), m(c("o_orderkey") % 4).alias("expanded"), F.lit(10).alias("n"), c("o_orderdate").alias("evaluated_at"))
    return ev.roll_up(x).drop("n", "last_evaluated_at").withColumns({k: F.round(k, 6) for k in ("base_mrr", "expanded_mrr")})


@query("a06_newest_evaluation", "SELECT max(o_orderkey) FILTER (o_orderstatus IN ('O', 'F')) AS n, count(*) AS count FROM orders")
def a06(spark, d):
    m = F.struct(*[F.lit(True).alias(k) for k in ("hit_at_1", "hit_at_3", "hit_at_5", "hit_at_n")], F.lit(1.0).alias("reciprocal_rank"))
    done = F.when(c("o_orderstatus") == "O", "hit").when(c("o_orderstatus") == "F", "miss").otherwise("evaluating")
    x = table(spark, d, "orders").select(done.alias("outcome"), m.alias("base"), m.alias("expanded"), c("o_orderkey").alias("n"), c("o_orderkey").cast("timestamp").alias("evaluated_at"))
    return ev.roll_up(x).select("n", "count")


@query("a10_upsert_counts", "SELECT l_orderkey AS doc_id, CAST(l_linenumber % 2 AS VARCHAR) AS version, count(*) AS n FROM lineitem GROUP BY 1, 2")
def a10(spark, d):
    return table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("doc_id"), (c("l_linenumber") % 2).cast("string").alias("version")).agg(F.count("*").alias("n"))


@query("a11_distinct_logged", "SELECT DISTINCT user_id AS doc_id FROM events WHERE event_type = 'click'")
def a11(spark, d):
    return table(spark, d, "events").where("event_type = 'click'").select(c("user_id").alias("doc_id")).distinct()


@query("u02_missing_assets", f"WITH {ASSETS}, d AS (SELECT doc_id, list(DISTINCT placeholder_id) AS p FROM assets GROUP BY 1) SELECT doc_id, len(list_filter(['t1', 't2', 't9'], lambda x: NOT list_contains(p, x))) AS missing FROM d")
def u02(spark, d):
    held = assets(spark, d).groupBy("doc_id").agg(F.collect_set("placeholder_id").alias("p"))
    return held.select("doc_id", F.size(at.missing_assets(F.array(*map(F.lit, ["t1", "t2", "t9"])), c("p"))).alias("missing"))


@query("a07_open_jobs", f"WITH {JOBS} SELECT count(*) FILTER (state IN ('queued', 'running')) AS open_jobs FROM jobs")
def a07(spark, d):
    return st.open_jobs(jobs(spark, d))


@query("a08_sequence_numbers", "SELECT event_id, user_id % 3 + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events")
def a08(spark, d):
    e = table(spark, d, "events").select(c("user_id").alias("doc_id"), c("event_id").alias("arrival"))
    return st.numbered(e, e.select("doc_id", (c("doc_id") % 3).alias("sequence")).distinct()).select(c("arrival").alias("event_id"), "sequence")


@query("a09_placeholder_faults", "WITH a AS (SELECT l_orderkey AS doc_id, l_returnflag AS placeholder_id, count(*) AS before, count(*) FILTER (l_linenumber <> 2) AS after FROM lineitem GROUP BY 1, 2) SELECT * FROM a WHERE before <> after")
def a09(spark, d):
    x = table(spark, d, "lineitem").select(c("l_orderkey").alias("doc_id"), c("l_returnflag").alias("placeholder_id"), "l_linenumber")
    return ck.placeholder_faults(x, x.where("l_linenumber <> 2"))


@query("a13_first_per_path", f"WITH {ASSETS} SELECT doc_id, path, arg_min(placeholder_id, ord) AS placeholder_id FROM assets GROUP BY 1, 2")
def a13(spark, d):
    return at.first_per_path(assets(spark, d))


@query("a14_run_counts", "SELECT count(*) FILTER (event_id % 4 = 0) AS requeued, count(*) FILTER (event_id % 4 = 1) AS captioned, count(*) FILTER (event_id % 4 = 2) AS requested, count(*) FILTER (event_id % 4 = 3) AS unreachable FROM events")
def a14(spark, d):
    return vs.run_counts(table(spark, d, "events").select(F.element_at(F.array(*map(F.lit, ["requeued", "captioned", "requested", "unreachable"])), (c("event_id") % 4 + 1).cast("int")).alias("step")))


# Changes

LATEST = "coalesce(active AND edition_date = max(edition_date) FILTER (active) OVER (PARTITION BY name), false)"


@query("m01_publish", f"WITH {FULL}, n AS (SELECT doc_id, name, edition_date, active OR doc_id % 10 = 0 AS active FROM cat_) SELECT doc_id, active, {LATEST} AS is_latest FROM n")
def m01(spark, d):
    x = full(spark, d).select("doc_id", "name", "edition_date", "active")
    return vs.publish(x, x.where("doc_id % 10 = 0")).select("doc_id", "active", c("is_latest_edition").alias("is_latest"))


@query("m02_activate", f"WITH {FULL} SELECT doc_id AS chunk_id, active OR doc_id % 10 = 0 AS active FROM cat_")
def m02(spark, d):
    x = full(spark, d).select(c("doc_id").alias("chunk_id"), "active")
    return vs.activate(x, x.where("chunk_id % 10 = 0"))


@query("m03_delete", f"WITH {FULL}, n AS (SELECT * FROM cat_ WHERE doc_id % 10 <> 0) SELECT doc_id, {LATEST} AS is_latest FROM n")
def m03(spark, d):
    x = full(spark, d)
    return vs.delete_documents(x, x.where("doc_id % 10 = 0")).select("doc_id", c("is_latest_edition").alias("is_latest"))


@query("m04_rename", f"WITH {FULL}, n AS (SELECT doc_id, active, CASE WHEN doc_id % 10 = 0 THEN 'moved' ELSE name END AS name, edition_date FROM cat_) SELECT doc_id, name, {LATEST} AS is_latest FROM n")
def m04(spark, d):
    x = full(spark, d).select("doc_id", "name", "label", "edition_date", "active")
    new = x.where("doc_id % 10 = 0").select("doc_id", F.lit("moved").alias("new_name"), c("label").alias("new_label"), c("edition_date").alias("new_date"))
    return vs.rename(x.withColumn("is_latest_edition", F.lit(False)), new).select("doc_id", "name", c("is_latest_edition").alias("is_latest"))


REC = "r AS (SELECT doc_id, job_id, CASE WHEN job_id % 5 = 0 THEN NULL ELSE job_id % 2 = 0 END AS act, state, prepared FROM jobs)"


def crash(spark, d):
    j = jobs(spark, d)
    return vs.recover(j.where("job_id % 5 <> 0").select("doc_id", "job_id", (c("job_id") % 2 == 0).alias("active")), j)


@query("m05_recover", f"WITH {JOBS}, {REC} SELECT job_id, coalesce(act, false) AS searchable, CASE WHEN act IS NULL THEN 'none' WHEN act THEN 'finish' ELSE 'drop' END AS action FROM r")
def m05(spark, d):
    return crash(spark, d).select("job_id", "searchable", "action")


@query("m07_supersede", f"WITH {JOBS}, n AS (SELECT c_custkey AS doc_id FROM customer WHERE c_custkey % 2 = 0) SELECT job_id, CASE WHEN state = 'queued' AND doc_id IN (SELECT doc_id FROM n) THEN 'superseded' ELSE state END AS state, accepted_order FROM jobs UNION ALL SELECT -doc_id, 'queued', (SELECT max(job_id) FROM jobs) + doc_id FROM n")
def m07(spark, d):
    new = table(spark, d, "customer").where("c_custkey % 2 = 0").select(c("c_custkey").alias("doc_id"), (-c("c_custkey")).alias("job_id"), c("c_custkey").alias("pos"))
    return vs.submit(jobs(spark, d), new).select("job_id", "state", "accepted_order")


@query("m08_job_steps", f"""WITH {JOBS} SELECT job_id, CASE WHEN state = 'queued' THEN 'running' WHEN state = 'running' AND job_id % 3 = 0 THEN 'succeeded' WHEN state = 'running' THEN 'failed' ELSE state END AS state,
  CASE WHEN state = 'queued' THEN 'chunking' END AS stage, CASE WHEN state = 'running' AND job_id % 3 <> 0 THEN 'INTERNAL_ERROR' END AS failure_code, CASE WHEN state = 'running' AND job_id % 3 = 0 THEN job_id END AS chunk_count FROM jobs""")
def m08(spark, d):
    j = jobs(spark, d)
    ends = j.select("job_id", F.lit(1).alias("arrival"), F.when(c("job_id") % 3 == 0, "succeed").otherwise("fail").alias("step"), F.lit("odd").alias("code"), c("job_id").alias("chunk_count"))
    starts = j.select("job_id", F.lit(2).alias("arrival"), F.lit("start").alias("step"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("chunk_count"))
    return vs.job_steps(j, ends.union(starts)).select("job_id", "state", "stage", "failure_code", "chunk_count")


@query("m12_edit", f"WITH {FULL} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'edited' ELSE name END AS name, doc_id % 3 = 0 AS moved, CASE WHEN doc_id % 6 = 0 THEN CAST(2 + doc_id % 12 AS VARCHAR) ELSE latest_version END AS latest_version FROM cat_")
def m12(spark, d):
    x = full(spark, d)
    change = x.where("doc_id % 3 = 0").select("doc_id", F.lit("edited").alias("name"), F.lit(None).cast("string").alias("label"), (c("doc_id") % 2 == 0).alias("hints_changed"))
    now = F.lit("2030-01-01").cast("timestamp")
    return vs.edit(x, change, now).select("doc_id", "name", (c("entered_at") == now).alias("moved"), "latest_version")


@query("m13_inherit_hints", f"WITH {ASSETS} SELECT doc_id, placeholder_id, CASE WHEN placeholder_id IN ('t3', 't5') AND table_id IS NULL THEN 'new' ELSE hint END AS hint, '2' AS version FROM assets")
def m13(spark, d):
    return at.inherit(assets(spark, d), spark.createDataFrame([("t3", "new"), ("t5", "new")], "placeholder_id string, hint string"), "2").select("doc_id", "placeholder_id", "hint", "version")


@query("m14_pair_images", f"WITH {ASSETS} SELECT doc_id, placeholder_id, CASE WHEN ord % 2 = 0 THEN 'k' || ord END AS file_key FROM assets")
def m14(spark, d):
    x = assets(spark, d)
    old = x.where("order % 2 = 0").dropDuplicates(["doc_id", "placeholder_id", "path"]).withColumn("file_key", F.concat(F.lit("k"), c("order").cast("string")))
    return at.pair_images(x.withColumn("file_key", F.lit(None).cast("string")), old).select("doc_id", "placeholder_id", "file_key")


@query("m15_temporary_to_pending", f"WITH {ASSETS} SELECT doc_id, placeholder_id, CASE WHEN is_temporary THEN 'pending' ELSE hint_status END AS hint_status FROM assets")
def m15(spark, d):
    return at.temporary_to_pending(assets(spark, d)).select("doc_id", "placeholder_id", "hint_status")


@query("m17_finished_records", f"WITH {RECORDS} SELECT record_id, CASE WHEN outcome = 'evaluating' AND record_id % 2 = 0 THEN 'hit' ELSE outcome END AS outcome FROM rec")
def m17(spark, d):
    r = records(spark, d)
    return ev.finished(r, r.where("record_id % 2 = 0").select("record_id", F.lit("hit").alias("outcome"))).select("record_id", "outcome")


@query("m18_claim_conflicts", f"WITH {FULL} SELECT doc_id FROM cat_ WHERE doc_id % 8 = 0")
def m18(spark, d):
    x = full(spark, d)
    return vs.claim(x, x.withColumn("queued_version", F.when(c("doc_id") % 8 == 0, "99").otherwise(c("queued_version"))), ["latest_version", "queued_version", "updated_at"]).select("doc_id")


@query("m19_request_outcomes", f"WITH {FULL} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['indexing', 'completed', 'failed'][doc_id % 3 + 1] ELSE state END AS state FROM cat_")
def m19(spark, d):
    x = full(spark, d).withColumns({"request_seq": c("doc_id") % 2, "job_id": F.lit("old")})
    out = x.select("doc_id", F.lit(0).alias("seq"), F.element_at(F.array(*map(F.lit, ["accepted", "reused", "rejected"])), (c("doc_id") % 3 + 1).cast("int")).alias("outcome"), F.lit("new").alias("job_id"))
    return vs.apply_outcome(x, out).select("doc_id", "state")


@query("m20_eligible", f"WITH {FULL} SELECT doc_id, latest_version AS version, doc_id % 2 = 0 AS force FROM cat_ WHERE state = 'queued' AND NOT deleted AND search_state <> 'replaced' AND queued_version = latest_version AND doc_id % 9 <> 0")
def m20(spark, d):
    return vs.eligible(full(spark, d), vers(spark, d).withColumn("origin", F.when(c("doc_id") % 2 == 0, "reindex").otherwise("upload"))).select("doc_id", "version", "force")


@query("m21_recover_versions", f"WITH {FULL} SELECT doc_id, CAST(doc_id % 12 AS VARCHAR) AS latest_version, CASE WHEN doc_id % 2 = 0 THEN 'completed' WHEN doc_id % 3 = 0 THEN 'failed' ELSE 'queued' END AS state FROM cat_ WHERE doc_id % 12 >= 2")
def m21r(spark, d):
    x = full(spark, d)
    v = lambda n: x.select("doc_id", n.cast("string").alias("version"), F.when(c("doc_id") % 2 == 0, "r").alias("result"), F.when(c("doc_id") % 3 == 0, "f").alias("failure"))
    older = v(c("doc_id") % 12).union(v(c("doc_id") % 12 - 1))
    return vs.recover_versions(x, older.where("cast(version as int) > 0")).where("cast(latest_version as int) >= 2")


@query("m23_caption_step", f"WITH {FULL} SELECT doc_id, CASE WHEN state <> 'captioning' THEN state WHEN doc_id % 4 = 1 THEN 'queued' ELSE 'indexing' END AS state FROM cat_")
def m23(spark, d):
    x = full(spark, d)
    return vs.caption_step(x, x.where("doc_id % 4 = 1").select("doc_id")).select("doc_id", "state")


@query("m25_restart_jobs", f"WITH {JOBS}, {REC} SELECT job_id, CASE WHEN state = 'queued' OR state = 'running' AND NOT (coalesce(act, false) AND prepared) THEN 'failed' WHEN state = 'running' THEN 'succeeded' ELSE state END AS state FROM r")
def m25(spark, d):
    return vs.restart_jobs(jobs(spark, d), crash(spark, d)).select("job_id", "state")


@query("m26_state_logs", f"WITH {FULL} SELECT doc_id, state AS from_state, CASE WHEN doc_id % 2 = 0 THEN 'failed' ELSE 'completed' END AS to_state, CASE WHEN doc_id % 2 = 0 THEN 'failure' ELSE 'success' END AS outcome FROM cat_ WHERE state <> CASE WHEN doc_id % 2 = 0 THEN 'failed' ELSE 'completed' END")
def m26(spark, d):
    x = full(spark, d)
    new = x.withColumn("state", F.when(c("doc_id") % 2 == 0, "failed").otherwise("completed"))
    return vs.state_logs(x, new, F.current_timestamp()).drop("occurred_at")


@query("m27_finish_deletion", f"WITH {FULL} SELECT doc_id, deleted AND doc_id % 3 = 0 AS purged, doc_id % 3 <> 0 AS pending_delete FROM cat_")
def m27(spark, d):
    x = full(spark, d).withColumns({"purged": F.lit(False), "pending_delete": F.lit(True)})
    ack = x.where("doc_id % 3 < 2").select("doc_id", F.when(c("doc_id") % 3 == 0, F.lit("2030-01-01")).otherwise("2020-01-01").cast("timestamp").alias("read_at"))
    return vs.finish_deletion(x, ack).select("doc_id", "purged", "pending_delete")


# Events


@query("t02_results_needed", "SELECT user_id AS doc_id, event_id AS arrival FROM (SELECT *, max(event_id % 97) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events WHERE event_id % 2 = 1 OR event_id % 3 = 0) WHERE b IS NULL OR event_id % 97 > b")
def t02(spark, d):
    e = table(spark, d, "events").select(c("user_id").alias("doc_id"), c("event_id").alias("arrival"), c("event_id").alias("job_id"), (c("event_id") % 97).alias("sequence"), F.when(c("event_id") % 2 == 0, "succeeded").otherwise("failed").alias("job_state"))
    return st.accepted(e, e.where("job_id % 3 = 0").select("doc_id", "job_id")).select("doc_id", "arrival")


@query("t04_reconcile", f"WITH {FULL} SELECT doc_id, state FROM cat_ WHERE queued_version IS NULL AND NOT deleted AND search_state <> 'replaced' AND (state = 'queued' OR state = 'indexing' AND doc_id % 2 = 0)")
def t04(spark, d):
    x = full(spark, d).withColumn("job_id", c("doc_id"))
    return st.reconcile(x, x.select("job_id", F.when(c("doc_id") % 2 == 0, "succeeded").otherwise("running").alias("state"))).select("doc_id", "state")


@query("t08_recent_logs", "SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def t08(spark, d):
    e = table(spark, d, "events")
    end = F.broadcast(e.agg(F.max("ts").alias("now")))
    return st.recent(e.join(end), "ts", c("now"), 7).select("event_id")
