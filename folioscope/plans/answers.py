"""Model answers and real splits over whole texts, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as ck
from ..sources.store import spread
from .base import query
from .corpus import table

c = F.col
#: Words of a chunk in c13_split_chunks.
LIMIT = 64


@query("x30_boundary_faults", """WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents),
  i AS (SELECT doc_id, t, unnest(range(1, CAST(doc_id % 4 + 2 AS BIGINT))) AS j FROM d),
  f AS (SELECT doc_id, j, CASE WHEN (doc_id + j) % 17 = 0 THEN 'bad_item' WHEN j > len(t) OR (doc_id + 2 * j) % 13 = 0 THEN 'line_out_of_range' WHEN trim(t[j], ' ') = '' THEN NULL
    WHEN (doc_id + j) % 9 = 0 THEN 'empty_title' WHEN doc_id * j % 11 = 0 THEN 'empty_summary' END AS fault FROM i),
  g AS (SELECT doc_id, count(*) AS n, arg_min(fault, j) FILTER (fault IS NOT NULL) AS fault FROM f GROUP BY 1)
  SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN 'not_json' WHEN doc_id % 19 = 0 THEN 'no_chunks' ELSE fault END AS fault, CAST(CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN 0 ELSE n END AS INTEGER) AS n_sections FROM g""")
def x30_faults(spark, d):
    """Answers of one to four sections for all documents: cut short, empty, with texts for numbers, lines beyond the text, blank titles and summaries."""
    x, j = c("doc_id"), lambda v: v.cast("bigint")
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    quoted = lambda v: F.concat(F.lit('"'), v.cast("string"), F.lit('"'))
    start = lambda v: F.when((x + j(v)) % 17 == 0, quoted(v)).otherwise(v.cast("string"))
    end = lambda v: F.when((x + 2 * j(v)) % 13 == 0, n + 1).otherwise(v).cast("string")
    title = lambda v: F.when((x + j(v)) % 9 == 0, "  ").otherwise(F.concat(F.lit("t"), v.cast("string")))
    summary = lambda v: F.when(x * j(v) % 11 == 0, "").otherwise("s")
    item = lambda v: F.concat(F.lit('{"start_line": '), start(v), F.lit(', "end_line": '), end(v), F.lit(', "title": "'), title(v), F.lit('", "summary": "'), summary(v), F.lit('"}'))
    items = F.when(x % 19 == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), (x % 4 + 1).cast("int")), item), ", "))
    response = F.concat(F.lit('{"chunks": ['), items, F.when(x % 23 == 0, "").otherwise("]}"))
    made = ck.parsed_boundaries(table(spark, d, "documents").select("doc_id", "text").withColumn("response", response))
    return made.select("doc_id", "fault", F.size("sections").alias("n_sections"))


@query("c13_split_chunks", r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\s]+')) AS BIGINT) AS n_words, true AS numbered, true AS within, true AS in_groups FROM documents WHERE regexp_matches(text, '[^\s]')""")
def c13_split(spark, d):
    """Whole texts in chunks of at most LIMIT words: no word is lost or doubled, numbers have no gaps, and a chunk
    above the limit is a single sentence or line; the cuts themselves are tested against others one by one."""
    made = ck.chunk(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", LIMIT).where("kind = 'text'")
    words = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))
    measured = F.size(F.regexp_extract_all("text", F.lit(r"(?U)[^\W_]+"), F.lit(0)))
    number = F.substring_index("chunk_key", "-", -1).cast("int")
    one = ~F.regexp_like(F.rtrim("text"), F.lit(r"\n|[.!?][ \t]\s*\S"))
    group = c("split_index").isNull() | c("split_index").between(1, c("split_total"))
    return made.groupBy("doc_id").agg(
        F.sum(words).alias("n_words"), ((F.min(number) == 0) & (F.max(number) + 1 == F.count("*")) & (F.count_distinct(number) == F.count("*"))).alias("numbered"),
        F.bool_and((measured <= LIMIT) | one).alias("within"), F.bool_and(group).alias("in_groups"),
    )
