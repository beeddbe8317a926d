"""Index runs, sweeps, deletions and the gate of searches over the driver's tables, each beside its SQL.

Stand-ins: services and models are small functions of a key; what changes while a run goes on is
every fifth target, which others queue in another version.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import index_run as ir
from .base import query
from .changes import FULL, JOBS, full, jobs
from .corpus import table

c = F.col


def caption():
    """Captions parts; of a few it never says anything, of others only when it is told of its fault."""
    silent = lambda part, fault: part % 7 == 0 or (part % 3 == 0 and fault is None)
    return lambda parts, faults: ["" if silent(p, f) else f" caption of {p} " for p, f in zip(parts, faults, strict=True)]


def request():
    return lambda ids, versions: [["accepted", "reused", "rejected", None][i // 12 % 4] for i in ids]


def run_of(spark, d):
    x = full(spark, d)
    later = x.withColumn("queued_version", F.when(F.expr("doc_id div 12 % 5 = 0") & c("queued_version").isNotNull(), "99").otherwise(c("queued_version")))
    # one asset for an order's lines of one number
    line = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("doc_id"), c("l_linenumber").alias("n")).agg(
        F.max("l_partkey").alias("part"), F.max("l_quantity").alias("q"), F.max("l_linestatus").alias("s"), F.max("l_returnflag").alias("r"))
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    made = line.select(
        "doc_id", (1 + c("doc_id") % 12).cast("string").alias("version"), text("t", c("n")).alias("placeholder_id"), F.when(c("r") == "N", "image").otherwise("table").alias("kind"), F.when(c("n") > 4, "t1").alias("table_id"),
        F.when(c("s") == "O", "pending").otherwise("done").alias("hint_status"), F.when(c("q") > 25, text("h", c("part"))).alias("hint"), (c("n") == 2).alias("is_temporary"), "part",
    )
    return ir.index_run(x, made, caption, request, ["part"], lambda: later)


TARGET = f"""{FULL}, s0 AS (SELECT *, CASE WHEN state = 'captioning' THEN 'queued' ELSE state END AS s FROM cat_),
  tg AS (SELECT *, s = 'queued' AND queued_version IS NOT NULL AND NOT deleted AND search_state <> 'replaced' AS target, (doc_id // 12) % 5 = 0 AS moved FROM s0)"""


@query("t09_index_run", f"""WITH {TARGET} SELECT doc_id, CASE WHEN target AND NOT moved THEN ['indexing', 'completed', 'failed', 'queued'][(doc_id // 12) % 4 + 1] ELSE s END AS state,
  CASE WHEN target AND NOT moved AND (doc_id // 12) % 4 < 3 THEN NULL WHEN moved AND queued_version IS NOT NULL THEN '99' ELSE queued_version END AS queued_version FROM tg""")
def t09(spark, d):
    """Documents after a run over all that wait."""
    return run_of(spark, d).docs.select("doc_id", "state", "queued_version")


@query("t09_captions", f"""WITH {TARGET}, a AS (SELECT l_orderkey AS doc_id, 't' || l_linenumber AS placeholder_id, max(l_partkey) AS part, CASE WHEN max(l_quantity) > 25 THEN 'h' || max(l_partkey) END AS hint,
    max(l_linestatus) = 'O' AS pending, l_linenumber = 2 AS tmp, l_linenumber > 4 AS inner_ FROM lineitem GROUP BY l_orderkey, l_linenumber),
  h AS (SELECT a.*, pending AND NOT inner_ AND coalesce(target AND NOT moved, false) AS asked FROM a LEFT JOIN tg USING (doc_id))
  SELECT doc_id, placeholder_id, CASE WHEN NOT asked THEN hint WHEN part % 7 = 0 THEN NULL ELSE 'caption of ' || part END AS hint,
    CASE WHEN asked THEN part % 7 = 0 ELSE tmp END AS is_temporary, CASE WHEN pending AND NOT asked THEN 'pending' ELSE 'done' END AS hint_status FROM h""")
def t09_captions(spark, d):
    """Assets after that run."""
    return run_of(spark, d).assets.select("doc_id", "placeholder_id", "hint", "is_temporary", "hint_status")


@query("t09_run_steps", f"""WITH {TARGET}, p AS (SELECT DISTINCT l_orderkey AS doc_id FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber <= 4)
  SELECT 'requeued' AS step, NULL AS detail, count(*) AS n FROM tg WHERE state = 'captioning' HAVING count(*) > 0
  UNION ALL SELECT 'captioned', NULL, count(*) FROM tg JOIN p USING (doc_id) WHERE target HAVING count(*) > 0
  UNION ALL SELECT 'stopped', 'superseded', count(*) FROM tg WHERE target AND moved HAVING count(*) > 0
  UNION ALL SELECT 'requested', ['accepted', 'reused', 'rejected', 'unreachable'][(doc_id // 12) % 4 + 1], count(*) FROM tg WHERE target AND NOT moved GROUP BY 2
  UNION ALL SELECT 'unreachable', NULL, count(*) FROM tg WHERE target AND NOT moved AND (doc_id // 12) % 4 = 3 HAVING count(*) > 0""")
def t09_steps(spark, d):
    """What that run did, counted."""
    return run_of(spark, d).steps.groupBy("step", "detail").agg(F.count("*").alias("n"))


def service():
    def send(request: str, doc_id: int) -> None:
        if doc_id % 7 == 0 or (request == "metadata" and doc_id % 5 == 0):
            raise ConnectionError(doc_id)

    return send


@query("m24_retry_sweep", f"""WITH {FULL}, f AS (SELECT doc_id, doc_id % 3 = 0 OR deleted AND doc_id % 2 = 1 AS del, doc_id % 4 = 0 AS meta, doc_id % 7 = 0 AS down, doc_id % 5 = 0 AS no_meta FROM cat_)
  SELECT doc_id, 'delete_chunks' AS request, NOT down AS sent, CASE WHEN down THEN 'ConnectionError' END AS error FROM f WHERE del
  UNION ALL SELECT doc_id, 'metadata', NOT (down OR no_meta), CASE WHEN down OR no_meta THEN 'ConnectionError' END FROM f WHERE meta AND NOT (del AND down)""")
def m24(spark, d):
    x = full(spark, d).withColumns({"purged": c("doc_id") % 2 == 0, "pending_delete": c("doc_id") % 3 == 0, "pending_metadata": c("doc_id") % 4 == 0})
    return ir.retry_sweep(x, service)


GONE = f"{JOBS}, busy AS (SELECT DISTINCT doc_id FROM jobs WHERE state = 'running'), gone AS (SELECT c_custkey AS doc_id FROM customer WHERE c_custkey % 3 = 0)"


@query("m09_deletion_jobs", f"""WITH {GONE} SELECT job_id, CASE WHEN state = 'queued' AND doc_id IN (SELECT doc_id FROM gone) THEN 'failed' ELSE state END AS state,
  CASE WHEN state = 'queued' AND doc_id IN (SELECT doc_id FROM gone) THEN 'DOCUMENT_DELETED' END AS failure_code FROM jobs WHERE doc_id NOT IN (SELECT doc_id FROM gone) OR doc_id IN (SELECT doc_id FROM busy)""")
def m09(spark, d):
    j, _, _ = deletion(spark, d)
    return j.select("job_id", "state", "failure_code")


@query("m09_deletion_records", f"""WITH {GONE}, rec AS (SELECT * FROM (SELECT o_orderkey AS chunk_id, o_custkey AS doc_id, o_orderpriority AS name, o_orderdate AS edition_date FROM orders)
    WHERE doc_id NOT IN (SELECT doc_id FROM gone) OR doc_id IN (SELECT doc_id FROM busy))
  SELECT chunk_id, edition_date = max(edition_date) OVER (PARTITION BY name) AS is_latest_edition FROM rec""")
def m09_records(spark, d):
    _, r, _ = deletion(spark, d)
    return r.select("chunk_id", "is_latest_edition")


def deletion(spark, d):
    rec = table(spark, d, "orders").select(c("o_orderkey").alias("chunk_id"), c("o_custkey").alias("doc_id"), c("o_orderpriority").alias("name"), c("o_orderdate").alias("edition_date"), F.lit(True).alias("active"))
    return ir.delete_in_order(table(spark, d, "customer").where("c_custkey % 3 = 0").select(c("c_custkey").alias("doc_id")), jobs(spark, d), rec)


@query("t07_refused_searches", f"WITH {JOBS} SELECT item_id, (SELECT count(*) FROM jobs WHERE state IN ('queued', 'running')) AS open_jobs, (SELECT count(*) > 0 FROM jobs WHERE state IN ('queued', 'running')) OR (SELECT count(*) > 0 FROM documents WHERE doc_id % 6 = 1) AS refused FROM benchmark")
def t07(spark, d):
    return ir.refused(table(spark, d, "benchmark").select("item_id"), full(spark, d), jobs(spark, d))
