"""Index runs, retry sweeps, ordered deletions and the gate of searches on small tables worked out by hand."""

import time

from folioscope.operators import index_run as ir

DOC = "doc_id int, state string, deleted boolean, search_state string, queued_version string, name string"
ASSET = "doc_id int, version string, placeholder_id string, kind string, table_id string, hint_status string, hint string, is_temporary boolean, alt string"


def doc(i, state="queued", queued="1", deleted=False, search="not_searchable"):
    return (i, state, deleted, search, queued, f"n{i}")


def asset(i, place, kind="image", alt="a", status="pending", table=None, version="1"):
    return (i, version, place, kind, table, status, None, False, alt)


def models():
    """A caption model and an index service; made in a function, so that tasks get them by value."""

    def answers():
        def model(alts, faults):
            return [None if a == "never" or (a == "once" and f is None) else f"{a}!{f or ''}" for a, f in zip(alts, faults, strict=True)]

        return model

    def server():
        return lambda ids, versions: [{1: "accepted", 2: "reused", 3: "rejected", 4: "odd"}.get(i) for i in ids]

    return answers, server


def test_run(spark):
    docs = spark.createDataFrame([doc(1), doc(2), doc(3), doc(4), doc(5), doc(6, "captioning"), doc(7, deleted=True), doc(8, search="replaced"), doc(9, "completed", None), doc(10, "uploaded"), doc(11, "indexing", None)], DOC)
    assets = spark.createDataFrame(
        [asset(1, "t1"), asset(1, "t2", "table", "never"), asset(1, "t3", table="t2", status="done"), asset(2, "t1", "table", "once"), asset(2, "t1", version="0"), asset(3, "t1", alt=None), asset(7, "t1"), asset(9, "t1"), asset(4, "t1", status="done")],
        ASSET,
    )
    seen = []

    def now():
        seen.append(1)
        gone = "case when doc_id = 5 then true else deleted end"
        return docs.withColumn("deleted", ir.F.expr(gone)) if len(seen) > 2 else docs

    run = ir.index_run(docs, assets, *models(), ["alt"], now)
    got = {r.doc_id: (r.state, r.queued_version) for r in run.docs.collect()}
    assert got == {1: ("indexing", None), 2: ("completed", None), 3: ("failed", None), 4: ("queued", "1"), 5: ("queued", "1"), 6: ("queued", "1"), 7: ("queued", "1"), 8: ("queued", "1"), 9: ("completed", None), 10: ("uploaded", "1"), 11: ("indexing", None)}
    assert next(r.deleted for r in run.docs.collect() if r.doc_id == 5)  # the row as it is now
    hints = {(r.doc_id, r.version, r.placeholder_id): (r.hint, r.hint_status, r.is_temporary) for r in run.assets.collect()}
    assert hints == {
        (1, "1", "t1"): ("a!", "done", False), (1, "1", "t2"): (None, "done", True), (1, "1", "t3"): (None, "done", False), (2, "1", "t1"): ("once!empty", "done", False), (2, "0", "t1"): (None, "pending", False),
        (3, "1", "t1"): ("None!", "done", False), (7, "1", "t1"): (None, "pending", False), (9, "1", "t1"): (None, "pending", False), (4, "1", "t1"): (None, "done", False),
    }
    steps = sorted((r.step, r.doc_id, r.detail) for r in run.steps.collect())
    assert steps == [("captioned", 1, None), ("captioned", 2, None), ("captioned", 3, None), ("requested", 1, "accepted"), ("requested", 2, "reused"), ("requested", 3, "rejected"), ("requested", 4, "unreachable"), ("requested", 6, "unreachable"), ("requeued", 6, None), ("stopped", 5, "deleted"), ("unreachable", 4, None), ("unreachable", 6, None)]


def test_run_over_nothing(spark):
    docs, assets = spark.createDataFrame([], DOC), spark.createDataFrame([], ASSET)
    run = ir.index_run(docs, assets, *models(), ["alt"])
    assert run.docs.count() == run.assets.count() == run.steps.count() == 0


def test_reasons_to_stop(spark):
    waiting = spark.createDataFrame([(i, "1") for i in range(1, 8)], "doc_id int, version string")
    now = spark.createDataFrame([doc(1), doc(2, deleted=True, search="replaced"), doc(3, search="replaced", queued="2"), doc(4, queued="2"), doc(5, queued=None), doc(6, "indexing")], DOC)
    assert {r.doc_id: r.detail for r in ir.stopped(waiting, now).collect()} == {2: "deleted", 3: "replaced", 4: "superseded", 5: "superseded", 6: "state_changed", 7: "deleted"}


def test_retry_sweep(spark):
    rows = [(1, False, False, True, True), (2, True, False, None, None), (3, True, True, False, False), (4, False, False, False, True), (5, None, None, None, None), (6, False, False, True, True)]
    docs = spark.createDataFrame(rows, "doc_id int, deleted boolean, purged boolean, pending_delete boolean, pending_metadata boolean").coalesce(1)

    def service():
        def send(request, doc_id):
            time.sleep(0.01)
            if (request, doc_id) in (("delete_chunks", 6), ("metadata", 4)):
                raise OSError("down")

        return send

    got = sorted((r.doc_id, r.request, r.sent, r.error) for r in ir.retry_sweep(docs, service, 2).collect())
    # a failed deletion keeps the document's metadata from being sent, and nothing else
    assert got == [(1, "delete_chunks", True, None), (1, "metadata", True, None), (2, "delete_chunks", True, None), (4, "metadata", False, "OSError"), (6, "delete_chunks", False, "OSError")]
    assert ir.retry_sweep(docs.limit(0), service).count() == 0


def test_deletion_order(spark):
    jobs = spark.createDataFrame([(1, 1, "running", None), (1, 2, "queued", None), (2, 3, "queued", None), (2, 4, "succeeded", None), (3, 5, "queued", None), (None, 6, "queued", None)], "doc_id int, job_id int, state string, failure_code string")
    records = spark.createDataFrame([(1, 1, "N", "2024-01-01"), (2, 2, "N", "2024-02-01"), (3, 3, "M", "2024-01-01")], "chunk_id int, doc_id int, name string, edition_date string").withColumn("active", ir.F.lit(True))
    gone = spark.createDataFrame([(1,), (2,), (2,), (9,)], "doc_id int")
    j, r, waiting = ir.delete_in_order(gone, jobs, records)
    assert sorted((x.job_id, x.state, x.failure_code) for x in j.collect()) == [(1, "running", None), (2, "failed", "DOCUMENT_DELETED"), (5, "queued", None), (6, "queued", None)]
    assert sorted((x.chunk_id, x.is_latest_edition) for x in r.collect()) == [(1, True), (3, True)]
    assert [x.doc_id for x in waiting.collect()] == [1]


def test_refused(spark):
    asked = spark.createDataFrame([(1,), (2,)], "q int")
    jobs = spark.createDataFrame([(1, "queued"), (2, "running"), (3, "failed")], "job_id int, state string")
    docs = spark.createDataFrame([doc(1)], DOC)
    assert [(r.open_jobs, r.refused) for r in ir.refused(asked, docs, jobs).collect()] == [(2, True)] * 2
    assert [(r.open_jobs, r.refused) for r in ir.refused(asked, docs, jobs.limit(0)).collect()] == [(0, False)] * 2
    assert [(r.open_jobs, r.refused) for r in ir.refused(asked, docs.withColumn("state", ir.F.lit("captioning")), jobs.limit(0)).collect()] == [(0, True)] * 2
