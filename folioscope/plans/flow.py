"""The whole search over chunks of whole texts, beside its SQL.

Chunks are lines, two of which make a group of fragments; the dense leg finds a document's first
line, by the stand-in vectors of `reference`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import retrieval as rt
from ..operators import search
from ..operators import versions as vs
from .base import query
from .corpus import DOCS_SQL, LINES_SQL, docs, lines, table
from .reference import ASK, W

c = F.col


@query(
    "k19_search_results",
    f"""WITH {LINES_SQL}, {DOCS_SQL}, post AS (SELECT doc_id, pos, term, count(*) AS tf FROM (SELECT doc_id, pos, unnest({W.format('text')}) AS term FROM chunks) GROUP BY 1, 2, 3),
  {ASK}, n AS (SELECT count(*) AS n FROM (SELECT DISTINCT doc_id, pos FROM post)),
  idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, n WHERE term IN (SELECT term FROM ask) GROUP BY term, n),
  kscore AS (SELECT item_id, doc_id, pos, sum(tf * idf) AS score FROM post JOIN ask USING (term) JOIN idf USING (term) GROUP BY 1, 2, 3),
  krank AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id, pos) AS rank FROM kscore) WHERE rank <= 30),
  qd AS (SELECT item_id, embedding AS qe FROM benchmark JOIN embeddings ON vec_id = item_id),
  vscore AS (SELECT item_id, vec_id AS doc_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])) AS score FROM embeddings, qd),
  vrank AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM vscore) WHERE rank <= 30),
  ls AS (SELECT item_id, doc_id, pos, rank FROM krank UNION ALL SELECT item_id, doc_id, 0, rank FROM vrank),
  fused AS (SELECT item_id, doc_id, pos, sum(1.0 / (60 + rank)) AS fused, min(rank) AS best_rank FROM ls GROUP BY 1, 2, 3),
  frank AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(fused, 12) DESC, best_rank, doc_id, pos) AS fused_rank FROM fused),
  newest AS (SELECT name, max(edition_date) AS newest FROM docs GROUP BY 1),
  s AS (SELECT item_id, doc_id, pos, fused + CASE WHEN edition_date = newest THEN 0.01 ELSE 0 END AS score, fused_rank FROM frank JOIN docs USING (doc_id) JOIN newest USING (name) SEMI JOIN chunks USING (doc_id, pos)),
  o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, fused_rank) AS ord FROM s),
  g AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ord) AS rank FROM (SELECT item_id, doc_id, pos // 2 AS g, max(score) AS score, min(ord) AS ord FROM o GROUP BY 1, 2, 3)),
  t AS (SELECT g.*, name, label FROM g JOIN docs USING (doc_id) WHERE rank <= 10),
  tok AS (SELECT doc_id, pos, pos // 2 AS g, text, len({W.format('text')}) AS n FROM chunks WHERE doc_id IN (SELECT doc_id FROM t)),
  span AS (SELECT doc_id, g, min(pos) AS lo, max(pos) AS hi, string_agg(text, '|' ORDER BY pos) AS chunks FROM tok SEMI JOIN t USING (doc_id, g) GROUP BY 1, 2),
  near AS (SELECT span.doc_id, span.g, pos, pos < lo AS b, CASE WHEN pos < lo THEN lo - pos ELSE pos - hi END AS dist, n, text FROM span JOIN tok ON tok.doc_id = span.doc_id AND (pos < lo OR pos > hi)),
  run AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, g ORDER BY dist, CASE WHEN b THEN 0 ELSE 1 END ROWS UNBOUNDED PRECEDING) AS used FROM near),
  side AS (SELECT doc_id, g, string_agg(text, '|' ORDER BY pos) FILTER (b) AS before, string_agg(text, '|' ORDER BY pos) FILTER (NOT b) AS after FROM run WHERE used <= 80 GROUP BY 1, 2),
  e AS (SELECT *, label IS NOT NULL AND (SELECT count(DISTINCT u.label) FROM t u WHERE u.item_id = t.item_id AND u.name = t.name) > 1 AS other FROM t),
  v AS (SELECT * FROM e WHERE doc_id IN (SELECT doc_id FROM docs WHERE NOT deleted AND search_state <> 'replaced'))
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS rank, doc_id, round(score, 9) AS score, chunks, coalesce(before, '') AS before, coalesce(after, '') AS after,
    other AND count(*) OVER (PARTITION BY item_id, name) > CASE WHEN label IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY item_id, name, label) END AS other_editions
  FROM v JOIN span USING (doc_id, g) LEFT JOIN side USING (doc_id, g)""",
)
def k19(spark, d):
    """Keyword and dense hits fused, weighed for latest editions, grouped and completed, with neighbours, cut to what is visible."""
    known, asked = docs(spark, d), table(spark, d, "benchmark")
    rows = lines(spark, d).withColumn("chunk_id", F.struct("doc_id", "pos"))
    keyword = rt.keyword_search_texts(rows, asked, "chunk_id", "text", "item_id", "text", 30)
    v = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    vectors = asked.select("item_id").join(v.select(c("doc_id").alias("item_id"), c("embedding").alias("qe")), "item_id")
    dense = rt.dense_search(v, vectors, "doc_id", "embedding", "item_id", "qe", 30).withColumn("chunk_id", F.struct("doc_id", F.lit(0).alias("pos")))
    editions = vs.refresh_latest(known.withColumn("active", F.lit(True))).select("doc_id", "name", "label", "is_latest_edition")
    chunks = rows.join(editions, "doc_id").select(
        "chunk_id", "doc_id", F.lit("1").alias("version"), "name", "label", F.lit(True).alias("active"), F.lit("text").alias("kind"), F.expr("cast(pos div 2 as int)").alias("order"),
        F.concat(F.lit("split-"), F.expr("pos div 2")).alias("split_group"), (c("pos") % 2 + 1).alias("split_index"), F.concat(F.lit("text-"), "pos").alias("chunk_key"), "text",
        F.array().cast("array<string>").alias("heading_path"), F.size(tx.terms(c("text"))).alias("tokens"), F.array().cast("array<string>").alias("placeholder_ids"), "is_latest_edition",
    )
    # the few rows of the lists are read for hits, neighbours and names
    lists = [x.select("item_id", "chunk_id", "rank").cache() for x in (keyword, dense)]
    out = search.results(lists, chunks, "item_id", 10, 80, latest_weight=0.01, documents=known)
    text = lambda name: F.array_join(name, "|").alias(name)
    return out.select("item_id", "rank", "doc_id", F.round("score", 9).alias("score"), text("chunks"), text("before"), text("after"), "other_editions")
