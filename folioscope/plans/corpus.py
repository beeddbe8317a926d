"""Stand-ins for the catalogue on the driver's tables.

doc: documents; name: source; edition: lang and a date from the id, none where the id is divisible
by 7; chunk: a line of the text; queries: benchmark texts; dense vectors: embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import spread

DOCS_SQL = """docs AS (
  SELECT doc_id, source AS name, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS label,
    CASE WHEN doc_id % 7 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(doc_id % 11 AS INTEGER) END AS edition_date,
    doc_id % 5 <> 0 AS searchable, doc_id % 17 = 0 AS deleted,
    CASE WHEN doc_id % 13 = 0 THEN 'replaced' WHEN doc_id % 5 <> 0 THEN 'searchable' ELSE 'not_searchable' END AS search_state,
    CASE doc_id % 6 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'captioning' WHEN 2 THEN 'queued' WHEN 3 THEN 'indexing' WHEN 4 THEN 'completed' ELSE 'failed' END AS state,
    TIMESTAMP '2024-03-01 00:00:00' + (doc_id % 40) * INTERVAL '1' HOUR AS updated_at, text
  FROM documents)"""
LINES_SQL = """chunks AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, t[i] AS text
  FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    dated = F.col("doc_id") % 7 != 0
    states = F.array(*map(F.lit, ["uploaded", "captioning", "queued", "indexing", "completed", "failed"]))
    return d.select(
        "doc_id",
        F.col("source").alias("name"),
        F.when(dated, F.col("lang")).alias("label"),
        F.when(dated, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 11).cast("int"))).alias("edition_date"),
        (F.col("doc_id") % 5 != 0).alias("searchable"),
        (F.col("doc_id") % 17 == 0).alias("deleted"),
        F.when(F.col("doc_id") % 13 == 0, "replaced").when(F.col("doc_id") % 5 != 0, "searchable").otherwise("not_searchable").alias("search_state"),
        F.get(states, (F.col("doc_id") % 6).cast("int")).alias("state"),
        (F.lit("2024-03-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=(F.col("doc_id") % 40).cast("int"))).alias("updated_at"),
        "text",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
