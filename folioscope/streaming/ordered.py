"""Streams of state events with state per document: result gate, numbering, sessions, reconciling.

Each operator is a stateful processor; its result over a stream, whatever its micro-batches and
restarts, is that of the batch form in `events` over the same rows in the order of their arrival.
Within a micro-batch rows are sorted by arrival; across batches a row may not arrive before one that
was read earlier (`arrival` is the place in the producer's log).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that list and timer state need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _sorted(frames: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame | None:
    held = [f for f in frames if len(f)]
    return pd.concat(held).sort_values(list(by), kind="stable") if held else None


class _Gate(StatefulProcessor):
    """The cursor of a document, with events of finished jobs held until their results are there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sequence bigint")
        self.results = handle.getMapState("results", "job_id string", "there boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = _sorted(rows, "arrival")
        if frame is None:
            return
        last = self.last.get()[0] if self.last.exists() else -1
        keep = []
        for row in frame.itertuples(index=False):
            if row.kind == "result":
                self.results.updateValue((row.job_id,), (True,))
            elif row.sequence > last and (row.job_state != "succeeded" or self.results.containsKey((row.job_id,))):
                last = row.sequence
                keep.append((key[0], int(row.sequence), int(row.arrival), row.job_state))
        self.last.update((int(last),))
        if keep:
            yield pd.DataFrame(keep, columns=["doc_id", "sequence", "arrival", "job_state"])

    def close(self) -> None:
        pass


def gated_stream(events: DataFrame, results: DataFrame) -> DataFrame:
    """doc_id, sequence, arrival, job_state of the events that are applied.

    events: doc_id, job_id, sequence, arrival, job_state; results: doc_id, job_id, arrival, a row
    when the result of a job is stored.  A succeeded event whose result is not there when it arrives
    is neither applied nor moves the cursor; a larger sequence wins over a gap.  Results are told by
    documents, so the state of a document holds its own jobs only.
    """
    e = events.select("doc_id", F.col("job_id").cast("string").alias("job_id"), "sequence", "arrival", "job_state", F.lit("event").alias("kind"))
    r = results.select("doc_id", F.col("job_id").cast("string").alias("job_id"), F.lit(None).cast(e.schema["sequence"].dataType).alias("sequence"), "arrival", F.lit(None).cast("string").alias("job_state"), F.lit("result").alias("kind"))
    kind = T.StructType([e.schema["doc_id"], T.StructField("sequence", T.LongType()), T.StructField("arrival", T.LongType()), T.StructField("job_state", T.StringType())])
    return e.unionByName(r).groupBy("doc_id").transformWithStateInPandas(_Gate(), kind, "append", "none")


class _Number(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "sequence bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = _sorted(rows, "arrival")
        if frame is None:
            return
        last = self.last.get()[0] if self.last.exists() else 0
        self.last.update((int(last + len(frame)),))
        yield pd.DataFrame({"doc_id": frame["doc_id"], "arrival": frame["arrival"].astype("int64"), "sequence": range(last + 1, last + 1 + len(frame))})

    def close(self) -> None:
        pass


def numbered_stream(changes: DataFrame) -> DataFrame:
    """doc_id, arrival, sequence: the changes of each document numbered from 1 without gaps."""
    kind = T.StructType([changes.schema["doc_id"], T.StructField("arrival", T.LongType()), T.StructField("sequence", T.LongType())])
    return changes.select("doc_id", "arrival").groupBy("doc_id").transformWithStateInPandas(_Number(), kind, "append", "none")


class _Session(StatefulProcessor):
    """Open batches of activity of a key; a timer closes each when the watermark is past its end.

    As in a session window, an event just at the end of a batch still belongs to it.
    """

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "first bigint, last bigint, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = _sorted(rows, "ms")
        if frame is None:
            return
        spans = sorted([*(tuple(x) for x in self.open.get()), *((int(t), int(t), 1) for t in frame["ms"])])
        merged: list[tuple[int, int, int]] = []
        for first, last, n in spans:
            if merged and first <= merged[-1][1] + self.idle:
                merged[-1] = (merged[-1][0], max(merged[-1][1], last), merged[-1][2] + n)
            else:
                merged.append((first, last, n))
        self.open.put(merged)
        for _, last, _ in merged:
            self.handle.registerTimer(last + self.idle + 1)
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        spans = [tuple(x) for x in self.open.get()]
        done = [s for s in spans if s[1] + self.idle < at]
        if done:
            rest = [s for s in spans if s not in done]
            self.open.put(rest) if rest else self.open.clear()
            yield pd.DataFrame([(key[0], s[0], s[1] + self.idle, s[2]) for s in done], columns=["key", "start_ms", "end_ms", "n"])

    def close(self) -> None:
        pass


def session_stream(events: DataFrame, key: str, ts: str, idle_seconds: int = 300, late: str = "0 seconds") -> DataFrame:
    """key, start, end, n of batches of activity that ended: no event of the key for the idle time.

    A batch is given once, when the watermark (the newest event less `late`) is past its end; events
    later than that are dropped by Spark's watermark rule.  Equals `sessions` for all that is closed.
    """
    rows = events.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms")).withWatermark("ts", late)
    kind = T.StructType([T.StructField("key", events.schema[key].dataType), T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType()), T.StructField("n", T.LongType())])
    out = rows.groupBy("key").transformWithStateInPandas(_Session(idle_seconds * 1000), kind, "append", "eventTime")
    return out.select(F.col("key").alias(key), F.timestamp_millis("start_ms").alias("start"), F.timestamp_millis("end_ms").alias("end"), "n")


class _Reconcile(StatefulProcessor):
    """The last known state of a job and of its document; a timer asks again while they differ."""

    def __init__(self, every: int) -> None:
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "document string, job string, asked bigint")

    def _differs(self, known: tuple) -> bool:
        return known[0] is not None and known[1] is not None and known[0] != known[1]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = _sorted(rows, "arrival")
        if frame is None:
            return
        known = tuple(self.known.get()) if self.known.exists() else (None, None, 0)
        for row in frame.itertuples(index=False):
            known = (row.state, known[1], known[2]) if row.kind == "document" else (known[0], row.state, known[2])
        self.known.update(known)
        if self._differs(known):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.every)
        return
        yield

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = tuple(self.known.get())
        if self._differs(known):
            self.known.update((known[0], known[1], known[2] + 1))
            self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.every)
            yield pd.DataFrame([(key[0], known[0], known[1], known[2] + 1)], columns=["doc_id", "state", "job_state", "asked"])

    def close(self) -> None:
        pass


def reconcile_stream(documents: DataFrame, jobs: DataFrame, every_seconds: int = 60) -> DataFrame:
    """doc_id, state, job_state, asked: documents whose job is in another state than they are, each time the sweep is due.

    documents, jobs: doc_id, state (of a job: the state that its document should have), arrival.
    A document is told again every `every_seconds` of processing time until both agree.
    """
    one = lambda df, kind: df.select("doc_id", "state", "arrival", F.lit(kind).alias("kind"))
    rows = one(documents, "document").unionByName(one(jobs, "job"))
    kind = T.StructType([documents.schema["doc_id"], T.StructField("state", T.StringType()), T.StructField("job_state", T.StringType()), T.StructField("asked", T.LongType())])
    return rows.groupBy("doc_id").transformWithStateInPandas(_Reconcile(every_seconds * 1000), kind, "append", "processingTime")
