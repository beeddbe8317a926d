"""A corpus pipeline: toxic texts go, one of each group of near copies stays, contaminated texts go,
personal data get surrogates, and what is left is encoded.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of docs.  Every stage
takes null keys and texts, empty and very long texts and repeated rows, other columns whatever
their names, and an empty table (which gives an empty one); what it does with them is said there.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, decontamination, jaccard_join, pii, toxicity
from folioscope.llm.cluster import checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity network, trained on the labelled rows of docs, takes for clean.

    Null and empty texts are scored like others (by the network's bias), repeated rows alike.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by 5-word shingles at a Jaccard similarity of 0.8: that of the least doc_id.

    Rows without words or without a doc_id stay; of rows with the same doc_id and text one stays.
    """
    return jaccard_join.one_of_each(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no more than a trace of a benchmark item.  Null and empty texts stay, and repeated rows are judged alike."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with surrogates for personal data; n_chars follows the text.  A null text stays null."""
    out = pii.replace(docs, key=pii.key_of(spark), report=False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids and the digests of the round trip of all rows; a null text is an empty one."""
    return bpe.encode(docs, bpe.vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", replace_pii),
    ("bpe", encode),
]

#: No stage but decontamination can be said in SQL; tests/llm/test_pipeline.py has plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and reread.

    The folder of a run is left to the cluster's cleaning, since the result is read from it later.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
    return docs
