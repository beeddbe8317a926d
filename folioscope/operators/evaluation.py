"""Retrieval quality: hit ranks, coverage, latest records, roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Characters from which a partly covered span counts.
LEAST_COVER = 10


def is_candidate(edition_only: Column, hit_doc: Column, hit_name: Column, doc: Column, name: Column) -> Column:
    return F.when(edition_only, hit_doc == doc).otherwise(hit_name == name)


def body(parts: list[Column]) -> Column:
    """Texts of a hit without white space, in one piece."""
    return F.array_join(F.transform(F.flatten(F.array(*parts)), tx.strip_space), "")


def metrics(hits: DataFrame, cases: DataFrame, text: Column, n: int = 10) -> DataFrame:
    """case_id, rank, hit_at_1, 3, 5 and n, reciprocal_rank, coverage of each case; text: a hit's body.

    The rank is that of the first candidate that holds the whole span.  Coverage counts every
    hit's longest common substring with the span, if it has ten characters or the whole span.
    """
    asked = cases.select("case_id", "edition_only", F.col("doc_id").alias("want_doc"), F.col("name").alias("want_name"), tx.strip_space(F.col("answer_span")).alias("span"))
    rows = hits.withColumn("body", text).join(asked, "case_id").where("span <> ''")
    fits = is_candidate(F.col("edition_only"), F.col("doc_id"), F.col("name"), F.col("want_doc"), F.col("want_name"))
    rank = rows.groupBy("case_id").agg(F.min(F.when(fits & F.contains("body", F.col("span")), F.col("rank"))).alias("rank"))
    whole = F.contains("body", F.col("span"))
    part = rows.withColumn("c", F.when(whole, F.struct((F.instr("body", F.lit("")) * 0).alias("start"), F.length("span").alias("size"))).otherwise(tx.common_span("span", "body")))
    good = part.where(F.col("c.size") >= F.least(F.lit(LEAST_COVER), F.length("span")))
    # what each part adds to those that start before it: the union of intervals without a row for each character
    spans = good.select("case_id", F.col("c.start").alias("from"), (F.col("c.start") + F.col("c.size")).alias("to"))
    reached = F.max("to").over(Window.partitionBy("case_id").orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1))
    gained = F.greatest(F.lit(0), F.col("to") - F.greatest("from", F.coalesce(reached, F.col("from"))))
    covered = spans.withColumn("gained", gained).groupBy("case_id").agg(F.sum("gained").alias("covered"))
    out = asked.join(rank, "case_id", "left").join(covered, "case_id", "left")
    hit = lambda k: F.coalesce(F.col("rank") <= k, F.lit(False)).alias(f"hit_at_{k}")
    at_n = F.coalesce(F.col("rank") <= n, F.lit(False)).alias("hit_at_n")
    return out.select("case_id", "rank", hit(1), hit(3), hit(5), at_n, F.coalesce(1 / F.col("rank"), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce(F.col("covered") / F.length("span"), F.lit(0.0)).alias("coverage"))


def evaluate(cases: DataFrame, hits: DataFrame, n: int = 10) -> DataFrame:
    """case_id, base, expanded (metrics as structs) and outcome of each case of an evaluation run.

    hits: the search's results of each case in all editions (case_id, rank, doc_id, name, chunks,
    before, after: arrays of texts).  The base body is the hit's chunks, the expanded one has its
    neighbours, too; a case is a hit if the expanded body of one of the first n holds the span.
    """
    out = cases.select("case_id")
    first = hits.where(F.col("rank") <= n)
    for kind, parts in (("base", ["chunks"]), ("expanded", ["before", "chunks", "after"])):
        got = metrics(first, cases, body([F.col(p) for p in parts]), n)
        out = out.join(got.select("case_id", F.struct(*[c for c in got.columns if c != "case_id"]).alias(kind)), "case_id", "left")
    return out.withColumn("outcome", outcome_of(F.coalesce(F.col("expanded.hit_at_n"), F.lit(False)), F.lit(None)))


def latest_records(records: DataFrame) -> DataFrame:
    """The newest record of each golden set; of equal times the larger record id."""
    newest = F.max_by(F.struct(*records.columns), F.struct("started_at", "record_id"))
    return records.groupBy("golden_set_id").agg(newest.alias("r")).select("r.*")


def golden_list(sets: DataFrame, records: DataFrame, outcome: str | None = None) -> DataFrame:
    """Sets with their newest record; sets without records are left out."""
    out = sets.join(latest_records(records), "golden_set_id")
    return out.where(F.col("outcome") == outcome) if outcome else out


def roll_up(records: DataFrame) -> DataFrame:
    """One row: counts, hit ratios and mean reciprocal ranks of finished records; 0 without any."""
    done = F.col("outcome").isin("hit", "miss") & F.col("base").isNotNull() & F.col("expanded").isNotNull()
    out = [F.count("*").alias("count"), F.count_if(F.col("outcome") == "evaluating").alias("evaluating")]
    for kind in ("base", "expanded"):
        for m in ("hit_at_1", "hit_at_3", "hit_at_5", "hit_at_n"):
            out.append(F.coalesce(F.avg(F.when(done, F.col(f"{kind}.{m}").cast("double"))), F.lit(0.0)).alias(f"{kind}_{m}"))
        out.append(F.coalesce(F.avg(F.when(done, F.col(f"{kind}.reciprocal_rank"))), F.lit(0.0)).alias(f"{kind}_mrr"))
    out += [F.max_by(F.when(done, F.col("n")), F.when(done, F.col("evaluated_at"))).alias("n"), F.max(F.when(done, F.col("evaluated_at"))).alias("last_evaluated_at")]
    return records.agg(*out)


def outcome_of(expanded_hit: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), "error").when(expanded_hit, "hit").otherwise("miss")


def orphans_removed(records: DataFrame, sets: DataFrame) -> DataFrame:
    return records.join(sets.select("golden_set_id"), "golden_set_id", "left_semi")


def finished(records: DataFrame, results: DataFrame) -> DataFrame:
    """Results are taken over only by records that are still evaluating."""
    r = results.select("record_id", F.col("outcome").alias("new_outcome"))
    out = records.join(r, "record_id", "left")
    return out.withColumn("outcome", F.when(F.col("outcome") == "evaluating", F.coalesce("new_outcome", "outcome")).otherwise(F.col("outcome"))).drop("new_outcome")
