"""Versions, editions, jobs: publishing, flags, recovery, state changes, as whole-table plans.

A change is a new table computed from the old one; `sources.store` publishes it in one step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def refresh_latest(records: DataFrame) -> DataFrame:
    """is_latest_edition of active records: the newest edition date of their name, all ties."""
    newest = F.max(F.when(F.col("active"), F.col("edition_date"))).over(Window.partitionBy("name"))
    return records.withColumn("is_latest_edition", F.coalesce(F.col("active") & (F.col("edition_date") == newest), F.lit(False)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new wins over old; of repeated keys in new, one row."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.dropDuplicates(keys))


def publish(records: DataFrame, new: DataFrame) -> DataFrame:
    """The documents of `new` get its records, active; their other records go; flags are refreshed."""
    docs = new.select("doc_id").distinct()
    return refresh_latest(records.join(docs, "doc_id", "left_anti").unionByName(new.withColumn("active", F.lit(True))))


def activate(records: DataFrame, ids: DataFrame) -> DataFrame:
    flag = ids.select("chunk_id").distinct().withColumn("__on", F.lit(True))
    return records.join(flag, "chunk_id", "left").withColumn("active", F.col("active") | F.coalesce("__on", F.lit(False))).drop("__on")


def delete_documents(records: DataFrame, docs: DataFrame) -> DataFrame:
    return refresh_latest(records.join(docs.select("doc_id"), "doc_id", "left_anti"))


def keep_ids(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Of the documents in ids (doc_id, chunk_id), records that are not in it go."""
    stale = records.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").join(ids.select("chunk_id"), "chunk_id", "left_anti")
    return records.join(stale.select("chunk_id"), "chunk_id", "left_anti")


def rename(records: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: doc_id, new_name, new_label, new_date; old and new names are refreshed together."""
    out = records.join(changes, "doc_id", "left")
    hit = F.col("new_name").isNotNull()
    out = out.withColumns({c: F.when(hit, F.col(n)).otherwise(F.col(c)) for c, n in (("name", "new_name"), ("label", "new_label"), ("edition_date", "new_date"))})
    return refresh_latest(out.select(*records.columns))


def recover(records: DataFrame, jobs: DataFrame) -> DataFrame:
    """doc_id, job_id, searchable, action of jobs after a crash: nothing, drop or finish."""
    state = records.groupBy("doc_id", "job_id").agg(F.bool_or("active").alias("any_active"))
    out = jobs.select("doc_id", "job_id").join(state, ["doc_id", "job_id"], "left")
    action = F.when(F.col("any_active").isNull(), "none").when(F.col("any_active"), "finish").otherwise("drop")
    return out.select("doc_id", "job_id", F.coalesce("any_active", F.lit(False)).alias("searchable"), action.alias("action"))


def restart_jobs(jobs: DataFrame, recovered: DataFrame) -> DataFrame:
    """Queued jobs fail; running ones succeed if searchable with a prepared result, else fail."""
    out = jobs.join(recovered.select("doc_id", "job_id", "searchable"), ["doc_id", "job_id"], "left")
    good = F.coalesce("searchable", F.lit(False)) & F.col("prepared")
    state = F.when(F.col("state") == "queued", "failed").when(F.col("state") == "running", F.when(good, "succeeded").otherwise("failed")).otherwise(F.col("state"))
    code = F.when((F.col("state").isin("queued", "running")) & (state == "failed"), "SERVER_RESTARTED").otherwise(F.col("failure_code"))
    return out.withColumns({"failure_code": code, "state": state}).select(*jobs.columns)


def latest_job(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("doc_id").agg(F.max_by(F.struct(*jobs.columns), "accepted_order").alias("j")).select("j.*")


def submit(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Queued jobs of the documents are superseded; new jobs follow in accepted order (new: doc_id, job_id, pos)."""
    last = jobs.agg(F.coalesce(F.max("accepted_order"), F.lit(0)).alias("last"))
    newest = new.groupBy("doc_id").agg(F.max("pos").alias("last_pos"))
    old = jobs.join(newest, "doc_id", "left").withColumn("state", F.when((F.col("state") == "queued") & F.col("last_pos").isNotNull(), "superseded").otherwise(F.col("state"))).select(*jobs.columns)
    state = F.when(F.col("pos") == F.col("last_pos"), "queued").otherwise("superseded")
    top = last.first()["last"]
    added = new.join(newest, "doc_id").select("doc_id", "job_id", state.alias("state"), (F.lit(top) + F.col("pos")).alias("accepted_order"))
    return old.unionByName(added, allowMissingColumns=True)


def searchable_jobs(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    return documents.join(jobs, documents["searchable_job_id"] == jobs["job_id"]).select(documents["*"], jobs["state"].alias("job_state"))


def replaced_editions(docs: DataFrame, survivors: DataFrame) -> DataFrame:
    """Earlier documents of a newly searchable edition: doc_id, search_state, state, failure_code."""
    # a later survivor is another document, so the latest of each edition decides
    s = survivors.groupBy(F.col("name").alias("s_name"), F.col("label").alias("s_label")).agg(F.max("entered_at").alias("s_at"))
    hit = (docs["name"] == s["s_name"]) & docs["label"].eqNullSafe(s["s_label"]) & (docs["entered_at"] < s["s_at"])
    gone = docs.where("not deleted and search_state <> 'replaced'").join(s, hit, "left_semi")
    busy = F.col("state").isin("uploaded", "captioning", "queued", "indexing")
    return gone.select("doc_id", F.lit("replaced").alias("search_state"), F.when(busy, "failed").otherwise(F.col("state")).alias("state"), F.when(busy, "REPLACED").alias("failure_code"))


def edit(docs: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """changes: doc_id, name, label, hints_changed (nulls: unchanged).  A new name or label enters the edition
    anew; changed hints make a next version."""
    c = changes.select("doc_id", F.col("name").alias("n"), F.col("label").alias("l"), "hints_changed")
    out = docs.join(c, "doc_id", "left")
    name, label = F.coalesce("n", "name"), F.coalesce("l", "label")
    moved = (name != F.col("name")) | ~label.eqNullSafe(F.col("label"))
    version = F.when(F.coalesce("hints_changed", F.lit(False)), (F.col("latest_version").cast("bigint") + 1).cast("string")).otherwise(F.col("latest_version"))
    return out.withColumns({"entered_at": F.when(moved, now).otherwise(F.col("entered_at")), "latest_version": version, "name": name, "label": label}).select(*docs.columns)


def claim(docs: DataFrame, expected: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of `expected` that are no longer as they were read; publishing needs this to be empty."""
    keys = ["doc_id", *columns]
    on = None
    for k in keys:
        c = docs[k].eqNullSafe(expected[k])
        on = c if on is None else on & c
    return expected.join(docs, on, "left_anti")


def apply_outcome(docs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """outcomes: doc_id, seq, outcome (accepted, reused, rejected), job_id.  A changed request is left alone."""
    o = outcomes.select("doc_id", F.col("seq").alias("o_seq"), "outcome", F.col("job_id").alias("o_job"))
    out = docs.join(o, "doc_id", "left")
    hit = F.col("request_seq").eqNullSafe(F.col("o_seq")) & F.col("outcome").isNotNull()
    state = F.when(F.col("outcome") == "accepted", "indexing").when(F.col("outcome") == "reused", "completed").otherwise("failed")
    return out.withColumns({"state": F.when(hit, state).otherwise(F.col("state")), "job_id": F.when(hit & (F.col("outcome") == "accepted"), F.col("o_job")).otherwise(F.col("job_id"))}).select(*docs.columns)


def eligible(docs: DataFrame, versions: DataFrame) -> DataFrame:
    """Queued documents whose record is there: doc_id, version, force (a reindex)."""
    v = versions.select("doc_id", F.col("version").alias("latest_version"), "origin")
    return docs.where("state = 'queued' and not deleted and search_state <> 'replaced' and queued_version = latest_version").join(v, ["doc_id", "latest_version"]).select("doc_id", F.col("latest_version").alias("version"), (F.col("origin") == "reindex").alias("force"))


def recover_versions(docs: DataFrame, versions: DataFrame) -> DataFrame:
    """Documents without the record of their latest version go back to the numerically largest earlier one."""
    lost = docs.join(versions.select("doc_id", F.col("version").alias("latest_version")), ["doc_id", "latest_version"], "left_anti")
    earlier = lost.select("doc_id", "latest_version").join(versions, "doc_id").where(F.col("version").cast("bigint") < F.col("latest_version").cast("bigint"))
    last = earlier.groupBy("doc_id").agg(F.max_by(F.struct("version", "result", "failure"), F.col("version").cast("bigint")).alias("v"))
    state = F.when(F.col("v.result").isNotNull(), "completed").when(F.col("v.failure").isNotNull(), "failed").otherwise("queued")
    return last.select("doc_id", F.col("v.version").alias("latest_version"), state.alias("state"))


def stop_reason(shutdown: Column, deleted: Column, replaced: Column, superseded: Column, changed: Column) -> Column:
    return F.when(shutdown, "shutdown").when(deleted, "deleted").when(replaced, "replaced").when(superseded, "superseded").when(changed, "state_changed")


def state_logs(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """One log of each changed state; failure only if the new state is failed."""
    o = old.select("doc_id", F.col("state").alias("from_state"))
    out = new.join(o, "doc_id").where(F.col("state") != F.col("from_state"))
    return out.select("doc_id", "from_state", F.col("state").alias("to_state"), F.when(F.col("state") == "failed", "failure").otherwise("success").alias("outcome"), now.alias("occurred_at"))


def caption_step(docs: DataFrame, pending: DataFrame) -> DataFrame:
    """Captioning documents without pending hints go on to indexing; others return to the queue."""
    p = pending.groupBy("doc_id").agg(F.count("*").alias("left"))
    return docs.join(p, "doc_id", "left").withColumn("state", F.when(F.col("state") == "captioning", F.when(F.coalesce("left", F.lit(0)) == 0, "indexing").otherwise("queued")).otherwise(F.col("state"))).drop("left")


def finish_deletion(docs: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """acknowledged: doc_id, read_at.  A flag stays if the row was edited since it was read."""
    out = docs.join(acknowledged, "doc_id", "left")
    done = F.col("read_at").isNotNull() & (F.col("updated_at") <= F.col("read_at"))
    return out.withColumns({"purged": F.col("purged") | (done & F.col("deleted")), "pending_delete": F.col("pending_delete") & ~done}).select(*docs.columns)


#: Codes of failed jobs (fixed values).
FAILURE_CODES = ["CHUNKING_FAILED", "MODEL_UNAVAILABLE", "STORE_UNAVAILABLE", "VECTOR_DIMENSION_MISMATCH", "DOCUMENT_DELETED", "SERVER_RESTARTED", "INTERNAL_ERROR"]


def failure_code(code: Column) -> Column:
    """The code that an error carries; INTERNAL_ERROR for errors without a known one."""
    return F.when(code.isin(FAILURE_CODES), code).otherwise("INTERNAL_ERROR")


def job_steps(jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """Jobs after their steps in order of arrival; a step that the state doesn't allow is ignored.

    jobs: job_id, state, stage, failure_code, chunk_count and more; steps: job_id, arrival, step
    (start, succeed, fail, fail_queued), code, chunk_count.  A job starts in the chunking stage;
    only running jobs succeed or fail, and fail_queued ends those that still wait.  Steps of one
    arrival are taken by name.
    """
    row = F.struct("arrival", "step", "code", F.col("chunk_count").cast("bigint").alias("n"))
    taken = steps.groupBy("job_id").agg(F.array_sort(F.collect_list(row)).alias("__steps"))
    none = F.lit(None)
    now = F.struct(F.col("state").alias("state"), F.col("stage").cast("string").alias("stage"), F.col("failure_code").cast("string").alias("code"), F.col("chunk_count").cast("bigint").alias("n"))
    to = lambda state, stage, code, n: F.struct(F.lit(state).alias("state"), stage.cast("string").alias("stage"), code.cast("string").alias("code"), n.cast("bigint").alias("n"))

    def move(s: Column, x: Column) -> Column:
        fails = ((s["state"] == "running") & (x["step"] == "fail")) | ((s["state"] == "queued") & (x["step"] == "fail_queued"))
        out = F.when((s["state"] == "queued") & (x["step"] == "start"), to("running", F.lit("chunking"), s["code"], s["n"]))
        out = out.when((s["state"] == "running") & (x["step"] == "succeed"), to("succeeded", none, s["code"], x["n"]))
        return out.when(fails, to("failed", none, failure_code(x["code"]), s["n"])).otherwise(s)

    end = F.aggregate(F.coalesce("__steps", F.array().cast(taken.schema["__steps"].dataType)), now, move)
    out = jobs.join(taken, "job_id", "left").withColumn("__e", end)
    return out.withColumns({"state": F.col("__e.state"), "stage": F.col("__e.stage"), "failure_code": F.col("__e.code"), "chunk_count": F.col("__e.n")}).select(*jobs.columns)


def string_version(versions: DataFrame) -> DataFrame:
    """The version searched when two are active: the largest as a string."""
    return versions.where("active").groupBy("doc_id").agg(F.max("version").alias("version"))


def run_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(F.col("step") == s).alias(s) for s in ("requeued", "captioned", "requested", "unreachable")])
