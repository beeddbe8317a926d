"""Seams for models: embedding, reranking, generation.  No model is part of the library."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.log import work_folder

KST = timezone(timedelta(hours=9))


def apply_model(rows: DataFrame, inputs: list[str], output: str, kind: str, load: Callable[[], Callable[..., list]] | None) -> DataFrame:
    """rows with a column `output`: load() makes the model once per task, which then gets batches of the inputs."""
    if load is None:
        raise ValueError(f"no model for {output}")
    schema = T.StructType([*rows.schema.fields, T.StructField(output, T._parse_datatype_string(kind))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            got = list(model(*[frame[c].tolist() for c in inputs]))
            if len(got) != len(frame):
                raise ValueError(f"{output}: {len(got)} results for {len(frame)} rows")
            yield frame.assign(**{output: got})

    return rows.mapInPandas(run, schema)


def in_rounds(rows: DataFrame, inputs: list[str], load: Callable[[], Callable[..., list]], check: Callable[[DataFrame], DataFrame], rounds: int = 3, wanted: Column | None = None) -> DataFrame:
    """rows with a model's `answer`, what `check` makes of it, `fault` (null: none) and `asked`, how often.

    load() makes the model once for each task; it gets batches of the inputs and of the faults of its
    last answers, null in the first round.  check adds `fault` (and what it likes) to rows that have
    an `answer`.  Only rows with a fault are asked again, at most `rounds` times; then they keep the
    last answer and its fault.  wanted: which rows are asked at all; the others have no answer.

    Each round is written to a folder of its own before the next one begins: no row is asked twice
    for one round, whatever reads the result, and a lost executor repeats its part of a round only.
    """
    spark, folder = rows.sparkSession, work_folder(rows.sparkSession, "rounds")
    fresh = rows.withColumns({"fault": F.lit(None).cast("string"), "__ask": F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))})
    open_, done = fresh.where("__ask").drop("__ask"), []
    for n in range(1, rounds + 1):
        asked = check(apply_model(open_, [*inputs, "fault"], "answer", "string", load)).withColumn("asked", F.lit(n))
        asked.write.parquet(f"{folder}/{n}")
        stored = spark.read.schema(asked.schema).parquet(f"{folder}/{n}")
        if n == rounds or stored.where("fault is not null").isEmpty():
            done.append(stored)
            break
        done.append(stored.where("fault is null"))
        open_ = stored.where("fault is not null").select(*rows.columns, "fault")
    out = fresh.where("not __ask").drop("__ask").withColumn("asked", F.lit(0))
    for part in done:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def longest_prefix(lines: list[str], fits: Callable[[str], bool]) -> str:
    """The longest prefix of lines that fits."""
    low, high = 0, len(lines)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if fits("\n".join(lines[:mid])) else (low, mid - 1)
    return "\n".join(lines[:low])


def next_run(cron: str, now: datetime, years: int = 8) -> datetime | None:
    """Next time of a five-field cron expression in Korean time; None if there is none in eight years."""

    def field(text: str, low: int, high: int) -> set[int]:
        out: set[int] = set()
        for part in text.split(","):
            span, _, step = part.partition("/")
            a, b = (low, high) if span == "*" else (int(span.split("-")[0]), int(span.split("-")[-1]))
            if step and "-" not in span and span != "*":
                b = high
            if not low <= a <= b <= high:
                raise ValueError(cron)
            out |= set(range(a, b + 1, int(step or 1)))
        return out

    parts = cron.split()
    if len(parts) != 5:
        raise ValueError(cron)
    minute, hour, day, month, week = (field(p, *r) for p, r in zip(parts, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7)), strict=True))
    week = {w % 7 for w in week}
    either = parts[2] != "*" and parts[4] != "*"
    at = now.astimezone(KST).replace(hour=0, minute=0, second=0, microsecond=0)
    start = now.astimezone(KST)
    for _ in range(366 * years):
        in_day, in_week = at.day in day, (at.weekday() + 1) % 7 in week
        if at.month in month and (in_day or in_week if either else in_day and in_week):
            for h in sorted(hour):
                for m in sorted(minute):
                    if (t := at.replace(hour=h, minute=m)) > start:
                        return t.astimezone(timezone.utc)
        at += timedelta(days=1)
    return None
