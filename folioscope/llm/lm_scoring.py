"""LM scoring: stupid-backoff scores of every document under the corpus's own n-gram counts.

Words are those of `LETTERS` (A-Z lower-cased).  The n-gram count tables are partitioned by
hash; the documents' exploded n-grams are joined to them partition by partition, both in packed
form (see exchange.py), and the scores are summed per document.

    S(w | context) = c(context w) / c(context)            if the n-gram is kept
                   = alpha * S(w | shorter context)       otherwise
    S(w) = c(w) / N

Unigrams are always kept, longer n-grams from `min_count` occurrences on (a text's own n-grams
would otherwise never back off).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exchange import Chunk, chunked, per_chunk, totals
from .words import LETTERS, shingles

ALPHA, ORDER, MIN_COUNT = 0.4, 3, 2
#: Text bytes of a chunk: the larger it is, the fewer bytes an n-gram takes.
CHUNK = 8 << 20


def _grams(h: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    return [shingles(h, first, n, short=False)[0] for n in range(1, order + 1)]


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT) -> DataFrame:
    """key, n_words, log_score (sum of ln S), mean_log_score: one row for each row of docs.

    A null or empty text has no words: log_score 0, mean_log_score null.  Repeated rows count
    as often as they occur, and a null key is kept.  An empty table gives no rows.  Texts are read whole,
    however long, and other columns are left out, whatever their names.
    """
    chunks = chunked(docs, key, text, LETTERS, CHUNK)
    n_total = chunks.agg(F.sum("n_words")).first()[0] or 0
    log_alpha, log_total = np.log(alpha), np.log(max(n_total, 1))
    answers = totals(chunks, lambda h, first: np.concatenate(_grams(h, first, order)), n_total, order)

    def sums(chunk: Chunk, total: np.ndarray) -> pa.Table:
        grams = _grams(chunk.hash, chunk.first, order)
        place = np.unique(np.concatenate(grams), return_inverse=True)[1]
        ends = np.cumsum([0, *map(len, grams)])
        counts = [total[place[ends[n] : ends[n + 1]]].astype(np.float64) for n in range(order)]
        n = np.diff(chunk.first)
        at = np.arange(len(chunk.hash)) - np.repeat(chunk.first[:-1], n)  # position in its row
        shorter = np.minimum(at, order - 1)
        s = np.log(counts[0]) - log_total + shorter * log_alpha
        for k in range(2, order + 1):
            spot = np.flatnonzero(at >= k - 1)
            before = np.flatnonzero(at >= k - 2)
            context = np.searchsorted(before, spot - 1)
            kept = counts[k - 1] >= min_count
            better = np.log(counts[k - 1]) - np.log(counts[k - 2][context]) + (shorter[spot] - (k - 1)) * log_alpha
            s[spot[kept]] = better[kept]
        row = np.repeat(np.arange(len(n)), n)
        log_score = np.bincount(row, weights=s, minlength=len(n))
        mean = pa.array(log_score / np.maximum(n, 1), mask=n == 0)
        return pa.table([chunk.keys, pa.array(n), pa.array(log_score), mean], names=[key, "n_words", "log_score", "mean_log_score"])

    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("n_words", T.LongType()), T.StructField("log_score", T.DoubleType()), T.StructField("mean_log_score", T.DoubleType())])
    return per_chunk(chunks, answers, sums, schema)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 4)})


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
tokens AS (
  SELECT doc_id, i, w[i] AS w3, CASE WHEN i > 1 THEN w[i - 1] END AS w2, CASE WHEN i > 2 THEN w[i - 2] END AS w1
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)),
total AS (SELECT count(*) AS n FROM tokens),
c1 AS (SELECT w3 AS a, count(*) AS c FROM tokens GROUP BY 1),
c2 AS (SELECT w2 AS a, w3 AS b, count(*) AS c FROM tokens WHERE w2 IS NOT NULL GROUP BY 1, 2),
c3 AS (SELECT w1 AS a, w2 AS b, w3 AS c_, count(*) AS c FROM tokens WHERE w1 IS NOT NULL GROUP BY 1, 2, 3),
scored AS (
  SELECT t.doc_id,
    CASE WHEN t.w1 IS NOT NULL AND c3.c >= 2 THEN ln(c3.c / h3.c)
         WHEN t.w2 IS NOT NULL AND c2.c >= 2 THEN ln(c2.c / h2.c) + CASE WHEN t.w1 IS NOT NULL THEN ln(0.4) ELSE 0 END
         ELSE ln(c1.c / total.n) + least(t.i - 1, 2) * ln(0.4) END AS s
  FROM tokens t CROSS JOIN total JOIN c1 ON c1.a = t.w3
  LEFT JOIN c1 h2 ON h2.a = t.w2 LEFT JOIN c2 ON c2.a = t.w2 AND c2.b = t.w3
  LEFT JOIN c2 h3 ON h3.a = t.w1 AND h3.b = t.w2
  LEFT JOIN c3 ON c3.a = t.w1 AND c3.b = t.w2 AND c3.c_ = t.w3),
sums AS (SELECT doc_id, sum(s) AS s FROM scored GROUP BY 1)
SELECT words.doc_id, len(w) AS n_words, round(coalesce(s, 0), 4) AS log_score,
       CASE WHEN len(w) > 0 THEN round(s / len(w), 4) END AS mean_log_score
FROM words LEFT JOIN sums USING (doc_id)
"""

QUERIES = {"op1_lm_scoring": op1_lm_scoring}
ORACLE_SQL = {"op1_lm_scoring": SQL}
