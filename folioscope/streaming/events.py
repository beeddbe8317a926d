"""Ordered state events: a cursor per document, sessions, sequence numbers, retention.

Events carry an arrival place; a shuffle does not keep order, so every fold sorts by it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from time import sleep

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.catalog import may_go, target_state, to_reconcile


def accepted(events: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Batch form of the cursor: events with a sequence above all that arrived before and were applied.

    events: doc_id, sequence, arrival, job_state.  With `results` (doc_id, job_id), a succeeded
    event without its result is neither applied nor moves the cursor.
    """
    rows = events
    if results is not None:
        there = results.select("doc_id", "job_id").distinct().withColumn("__r", F.lit(True))
        rows = rows.join(there, ["doc_id", "job_id"], "left").where((F.col("job_state") != "succeeded") | F.col("__r")).drop("__r")
    before = F.max("sequence").over(Window.partitionBy("doc_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__b", before).where("__b is null or sequence > __b").drop("__b")


def accepted_stream(events: DataFrame) -> DataFrame:
    """Streaming form: doc_id, sequence, arrival, job_state of applied events."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("arrival")
        last, keep = state.get[0] if state.exists else -1, []
        for s in rows["sequence"]:
            keep.append(s > last)
            last = max(last, s)
        state.update((int(last),))
        yield rows[keep][["doc_id", "sequence", "arrival", "job_state"]]

    return events.groupBy("doc_id").applyInPandasWithState(step, events.select("doc_id", "sequence", "arrival", "job_state").schema, "last bigint", "append", GroupStateTimeout.NoTimeout)


def apply_events(docs: DataFrame, events: DataFrame) -> DataFrame:
    """Documents after their accepted events: the last target that the state allows, the largest searchable version.

    events: doc_id, version, job_id, sequence, arrival, job_state, searchable_version.  An event
    counts only for the latest version and, if known, the document's job.
    """
    fine = accepted(events).join(docs.select("doc_id", "latest_version", F.col("job_id").alias("doc_job"), F.col("state").alias("old")), "doc_id")
    fine = fine.where((F.col("version") == F.col("latest_version")) & (F.col("doc_job").isNull() | (F.col("doc_job") == F.col("job_id"))))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("arrival", target_state(F.col("job_state")).alias("to")))), lambda x: x["to"])
    folded = fine.groupBy("doc_id", "old").agg(ordered.alias("targets"), F.max(F.col("searchable_version").cast("bigint")).alias("newest"))
    state = F.aggregate("targets", F.col("old"), lambda s, t: F.when(may_go(s, t), t).otherwise(s))
    new = folded.select("doc_id", state.alias("new_state"), "newest")
    out = docs.join(new, "doc_id", "left")
    version = F.when(F.col("newest") > F.coalesce(F.col("searchable_version").cast("bigint"), F.lit(-1)), F.col("newest").cast("string")).otherwise(F.col("searchable_version"))
    return out.withColumns({"state": F.coalesce("new_state", "state"), "searchable_version": version}).select(*docs.columns)


def numbered(changes: DataFrame, last: DataFrame) -> DataFrame:
    """Sequence numbers per document, going on from last (doc_id, sequence); changes carry an arrival."""
    l = last.select("doc_id", F.col("sequence").alias("__l"))  # noqa: E741
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("arrival"))
    return changes.join(l, "doc_id", "left").withColumn("sequence", F.coalesce("__l", F.lit(0)) + place).drop("__l")


def sessions(events: DataFrame, key: str, ts: str, idle: str = "300 seconds") -> DataFrame:
    """Batches of activity of a key that end after an idle time: key, start, end, n.  Works on streams with a watermark."""
    w = F.session_window(ts, idle)
    return events.groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def recent(events: DataFrame, ts: str, now, days: int) -> DataFrame:
    return events.where(F.col(ts) > now - F.make_dt_interval(F.lit(days)))


def reconcile(docs: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Documents with a request under way whose job's state differs from the snapshot: doc_id, job_id, state, job_state."""
    s = snapshot.select("job_id", F.col("state").alias("job_state"))
    return docs.where(to_reconcile()).join(s, "job_id").where(target_state(F.col("job_state")) != F.col("state")).select("doc_id", "job_id", "state", "job_state")


def open_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("state").isin("queued", "running")).alias("open_jobs"))


def ordered_sink(send: Callable[[dict], None], retries: int = 5, wait: Callable[[float], None] = sleep) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: events of a document in order, with waits of 1, 2, 4, ... seconds between tries."""

    def deliver(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent = 0
        for frame in rows:
            for row in frame.to_dict("records"):
                for attempt in range(retries + 1):
                    try:
                        send(row)
                        break
                    except OSError:
                        if attempt == retries:
                            raise
                        wait(2.0**attempt)
                sent += 1
        yield pd.DataFrame({"sent": [sent]})

    def batch(df: DataFrame, _: int) -> None:
        ready = df.repartition("doc_id").sortWithinPartitions("doc_id", "sequence")
        ready.mapInPandas(deliver, "sent bigint").agg(F.sum("sent")).collect()

    return batch


#: Fields of a received event; others are refused.
EVENT = "doc_id string, job_id string, version string, job_state string, index_state struct<searchable_version:string,latest_job_id:string,latest_job_state:string,latest_job_stage:string>, sequence bigint"


def received(raw: DataFrame, body: str, token: str | None = None, expected: str | None = None) -> DataFrame:
    """Parsed events with a fault column: token first, then body (null: accepted)."""
    known = ["doc_id", "job_id", "version", "job_state", "index_state", "sequence"]
    e = F.from_json(body, EVENT, {"mode": "PERMISSIVE"})
    extra = F.size(F.array_except(F.json_object_keys(body), F.array(*map(F.lit, known)))) > 0
    bad = e.isNull() | e["doc_id"].isNull() | e["sequence"].isNull() | (e["sequence"] < 1) | F.coalesce(extra, F.lit(True))
    fault = F.when(bad, "invalid")
    if token:
        fault = F.when(~F.col(token).eqNullSafe(F.lit(expected)), "unauthorised").otherwise(fault)
    return raw.select("*", e.alias("event"), fault.alias("fault"))
