"""One search from lists of hits to results: fusion, rerank, latest editions, fragments, neighbours, visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import retrieval as rt


#: Keys that may go to all tasks of a join.
FEW = 500_000


def _few(keys: DataFrame) -> DataFrame:
    """Keys of a search's lists, which are few beside the chunks; broadcast if they are."""
    kept = keys.cache()
    return F.broadcast(kept) if kept.count() <= FEW else kept


def results(lists: list[DataFrame], chunks: DataFrame, query_key: str, n: int, max_tokens: int, score: Column | None = None, latest_weight: float = 0.0, documents: DataFrame | None = None) -> DataFrame:
    """The first n results of each query: rank, doc_id, version, name, label, score, heading_path, chunks, before, after, other_editions.

    lists: query_key, chunk_id, rank of each retriever.  chunks: chunk_id, doc_id, version, name,
    label, active, kind, order, split_group, split_index, chunk_key, text, heading_path, tokens,
    placeholder_ids, is_latest_edition, and what `score`, a rerank score, is made of.  A fragment
    stands for its whole group, whose siblings are shown with it; chunks, before and after are the
    texts of the hit and of its neighbours within max_tokens.  documents (doc_id, deleted,
    search_state): only visible ones stay, renumbered.  n is 1 to 50.
    """
    if not 1 <= n <= rt.MOST_RESULTS:
        raise ValueError(f"n must be 1 to {rt.MOST_RESULTS}")
    # texts are read twice, without a shuffle: for the documents of what the lists hold, and for these documents' chunks
    active, both = chunks.where("active"), ["doc_id", "version"]
    wanted = rt.union([x.select("chunk_id") for x in lists]).distinct()
    docs = active.join(_few(wanted), "chunk_id", "left_semi").select(*both).distinct()
    active = active.join(_few(docs), both, "left_semi").cache()
    ranked = rt.rerank(rt.fuse(lists, query_key, "chunk_id").join(active, "chunk_id"), query_key, score, F.col("is_latest_edition"), latest_weight)
    groups = rt.group_fragments(ranked, query_key, "chunk_id", n)
    hits = rt.complete_fragments(groups, active, query_key, "chunk_id").withColumn("hit_id", F.struct(query_key, "rank"))
    # texts go along with the keys of their chunks
    near_chunks = active.join(hits.select(*both).distinct(), both, "left_semi").withColumn("piece", F.struct("chunk_id", "text"))
    pieces = F.transform("chunks", lambda c: F.struct(c["key"].alias("chunk_id"), c["text"].alias("text")))
    asked = hits.select("hit_id", "doc_id", "version", pieces.alias("members"), F.lit(None).cast("int").alias("asset_order"), F.array().cast("array<string>").alias("placeholder_ids"))
    near = rt.neighbours(asked, near_chunks, max_tokens, key="piece")
    texts = lambda c: F.transform(c, lambda x: x["text"]).alias(c)
    names = active.select("doc_id", "version", "name", "label").dropDuplicates(both)
    out = hits.join(near.select("hit_id", texts("before"), texts("after")), "hit_id").join(names, both)
    out = out.withColumns({"other_editions": rt.other_editions(out, query_key), "chunks": F.transform("chunks", lambda c: c["text"])})
    if documents is not None:
        out = rt.visible_results(out, documents, query_key)
    return out.select(query_key, "rank", "doc_id", "version", "name", "label", "score", "heading_path", "chunks", "before", "after", "other_editions")
