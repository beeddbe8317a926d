"""A scheduled index run, the sweep of unanswered requests and deletions, as whole-table steps.

A run takes leftovers back into the queue, fixes what waits in it, captions all images, then all
tables, asks for the index and returns what it couldn't finish.  Each step is stored in a folder of
the run before the next one begins, so no model or service is asked twice for one step, and a
lost executor repeats its part of a step only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.log import work_folder
from . import assets as at
from . import catalog as cat
from . import versions as vs
from .models import apply_model, in_rounds

#: Answers to an index request and the states that they lead to (fixed values); without an answer a document stays in the queue.
OUTCOMES = {"accepted": "indexing", "reused": "completed", "rejected": "failed"}
UNREACHABLE = "unreachable"
ASSET_KEYS = ["doc_id", "version", "placeholder_id"]


class Run(NamedTuple):
    """docs and assets after a run, and steps: doc_id, version, step, detail."""

    docs: DataFrame
    assets: DataFrame
    steps: DataFrame


def requeued(docs: DataFrame) -> DataFrame:
    """docs whose captioning an earlier run left open wait again."""
    return docs.withColumn("state", F.when(F.col("state") == "captioning", "queued").otherwise(F.col("state")))


def targets(docs: DataFrame) -> DataFrame:
    """doc_id and version of the documents that wait: what enters the queue later is the next run's."""
    return docs.where(cat.in_queue() & (F.col("state") == "queued")).select("doc_id", F.col("queued_version").alias("version"))


def stopped(waiting: DataFrame, now: DataFrame) -> DataFrame:
    """Targets that must not go on, by the documents as they are now: doc_id, version, detail (the first reason that holds).

    A document that is gone counts as deleted.
    """
    n = now.select("doc_id", "deleted", "search_state", "queued_version", F.col("state").alias("now_state"), F.lit(True).alias("there"))
    out = waiting.join(n, "doc_id", "left")
    yes = lambda x: F.coalesce(x, F.lit(False))
    reason = vs.stop_reason(
        F.lit(False), F.col("there").isNull() | yes(F.col("deleted")), yes(F.col("search_state") == "replaced"),
        ~F.col("version").eqNullSafe(F.col("queued_version")), ~yes(F.col("now_state").isin("queued", "captioning")),
    )
    return out.select("doc_id", "version", reason.alias("detail")).where("detail is not null")


def captioned(assets: DataFrame, waiting: DataFrame, kind: str, load: Callable[[], Callable[..., list]], inputs: list[str], rounds: int = 3) -> DataFrame:
    """assets of which the pending ones of a kind and of the waiting documents got a model's hint.

    Assets are unique by document, version and placeholder.  A blank answer is asked again, `rounds`
    times at most; then the asset is done without a hint of its own, for the time being.
    """
    asked = at.pending_hints(assets, kind).join(waiting.select("doc_id", "version"), ["doc_id", "version"], "left_semi")
    check = lambda rows: rows.withColumn("fault", F.when(F.trim(F.coalesce("answer", F.lit(""))) == "", "empty"))
    got = in_rounds(asked, inputs, load, check, rounds)
    new = got.select(*ASSET_KEYS, F.when(F.col("fault").isNull(), F.trim("answer")).alias("__hint"), F.lit(True).alias("__asked"))
    out = assets.join(new, ASSET_KEYS, "left")
    hit = F.coalesce("__asked", F.lit(False))
    put = lambda name, value: F.when(hit, value).otherwise(F.col(name))
    return out.withColumns({"hint": put("hint", F.col("__hint")), "is_temporary": put("is_temporary", F.col("__hint").isNull()), "hint_status": put("hint_status", F.lit("done"))}).select(*assets.columns)


def index_run(docs: DataFrame, assets: DataFrame, load_caption: Callable[[], Callable[..., list]], load_request: Callable[[], Callable[..., list]], inputs: list[str], current: Callable[[], DataFrame] | None = None, rounds: int = 3) -> Run:
    """One run over all documents that wait.

    docs: doc_id, state, deleted, search_state, queued_version and more; assets: those of
    `captioned`.  load_caption() makes a model of `inputs` and of the faults of its last answers;
    load_request() a service of (doc_id, version) that answers accepted, reused, rejected, or anything
    else where it wasn't reached.  current() reads the documents anew before each step: what was deleted, replaced,
    queued in another version or taken on by others since then leaves the run and keeps its present row.
    """
    spark, folder = docs.sparkSession, work_folder(docs.sparkSession, "index-run")

    def stored(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    def step(rows: DataFrame, name: str, detail: Column | None = None) -> DataFrame:
        return rows.select("doc_id", "version", F.lit(name).alias("step"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))

    left = docs.where("state = 'captioning'").select("doc_id", F.col("queued_version").alias("version"))
    docs = requeued(docs)
    waiting = stored(targets(docs), "targets")
    pending = at.pending_hints(assets, "image").unionByName(at.pending_hints(assets, "table")).select("doc_id", "version").distinct()
    steps = [step(left, "requeued"), step(waiting.join(pending, ["doc_id", "version"], "left_semi"), "captioned")]

    def still(name: str) -> None:
        nonlocal waiting
        if current is not None:
            out = stored(stopped(waiting, current()), f"stopped-{name}")
            steps.append(step(out, "stopped", F.col("detail")))
            waiting = waiting.join(out.select("doc_id", "version"), ["doc_id", "version"], "left_anti")

    for kind in ("image", "table"):  # all images before the first table
        still(kind)
        assets = stored(captioned(assets, waiting, kind, load_caption, inputs, rounds), kind)
    still("request")
    open_ = at.pending_hints(assets, "image").unionByName(at.pending_hints(assets, "table")).select("doc_id", "version")
    ready = waiting.join(open_, ["doc_id", "version"], "left_anti")
    answers = stored(apply_model(ready, ["doc_id", "version"], "outcome", "string", load_request), "answers")
    known = F.col("outcome").isin(list(OUTCOMES))
    answers = answers.withColumn("outcome", F.when(known, F.col("outcome")).otherwise(UNREACHABLE))
    steps += [step(answers, "requested", F.col("outcome")), step(answers.where(F.col("outcome") == UNREACHABLE), UNREACHABLE)]
    rows = docs if current is None else requeued(current())
    state = F.create_map(*[F.lit(x) for kv in OUTCOMES.items() for x in kv])
    out = rows.join(answers.select("doc_id", F.col("version").alias("queued_version"), "outcome"), ["doc_id", "queued_version"], "left")
    done = F.coalesce(F.col("outcome") != UNREACHABLE, F.lit(False))
    changed = {"state": F.when(done, F.element_at(state, F.col("outcome"))).otherwise(F.col("state")), "queued_version": F.when(~done, F.col("queued_version"))}
    all_steps = steps[0]
    for s in steps[1:]:
        all_steps = all_steps.union(s)
    return Run(out.withColumns(changed).select(*docs.columns), assets, all_steps)


def retry_sweep(docs: DataFrame, load: Callable[[], Callable[[str, object], None]], at_once: int = 4) -> DataFrame:
    """Requests that are still marked on documents, sent again: doc_id, request, sent, error.

    docs: doc_id, deleted, purged, pending_delete, pending_metadata.  A document's chunks are deleted
    before its metadata are sent.  load() makes a service of (request, doc_id), which fails by an
    exception, once for each task; a task sends for at_once documents at a time.  A failure stops that
    document's requests only, and its name is kept.
    """
    yes = lambda x: F.coalesce(x, F.lit(False))
    removes = yes(F.col("pending_delete")) | (yes(F.col("deleted")) & ~yes(F.col("purged")))
    asked = docs.select("doc_id", F.array_compact(F.array(F.when(removes, "delete_chunks"), F.when(yes(F.col("pending_metadata")), "metadata"))).alias("requests")).where(F.size("requests") > 0)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send = load()

        def of_one(doc_id: object, requests: list[str]) -> list[tuple]:
            out = []
            for r in requests:
                try:
                    send(r, doc_id)
                except Exception as e:  # one document's failure must not end the sweep
                    return [*out, (doc_id, r, False, type(e).__name__)]
                out.append((doc_id, r, True, None))
            return out

        with ThreadPoolExecutor(at_once) as pool:
            for frame in frames:
                found = [x for rows in pool.map(of_one, frame["doc_id"].tolist(), frame["requests"].tolist()) for x in rows]
                yield pd.DataFrame(found, columns=["doc_id", "request", "sent", "error"])

    return asked.mapInPandas(run, f"doc_id {kind}, request string, sent boolean, error string")


def delete_in_order(gone: DataFrame, jobs: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, records, waiting) after the documents in `gone` (doc_id) were deleted as far as they can be.

    Their queued jobs fail first, so none starts meanwhile.  A document with a running job waits, with
    its records: the job would write them again.  Of the others, records and jobs go, and the latest
    editions of the names are found anew.
    """
    asked = gone.select("doc_id").distinct()
    waiting = asked.join(jobs.where("state = 'running'"), "doc_id", "left_semi")
    ready = asked.join(jobs.where("state = 'running'"), "doc_id", "left_anti")
    kept = jobs.join(ready, "doc_id", "left_anti").join(waiting.withColumn("__gone", F.lit(True)), "doc_id", "left")
    hit = F.coalesce("__gone", F.lit(False)) & (F.col("state") == "queued")
    kept = kept.withColumns({"failure_code": F.when(hit, "DOCUMENT_DELETED").otherwise(F.col("failure_code")), "state": F.when(hit, "failed").otherwise(F.col("state"))})
    return kept.select(*jobs.columns), vs.delete_documents(records, ready), waiting


def refused(requests: DataFrame, docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """requests with `refused` and `open_jobs`: none is served while documents are captioned or jobs are open."""
    n_open = jobs.where(F.col("state").isin("queued", "running")).agg(F.count("*").alias("n")).scalar()
    n_busy = docs.where("state = 'captioning'").agg(F.count("*").alias("n")).scalar()
    return requests.withColumn("open_jobs", n_open).withColumn("refused", (F.col("open_jobs") > 0) | (n_busy > 0))
