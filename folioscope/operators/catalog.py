"""Catalogue and audit-log queries: filters, joins, sorted pages, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Processing states and search states in the order in which they are listed (fixed values).
STATES = ["uploaded", "captioning", "queued", "indexing", "completed", "failed"]
SEARCH_STATES = ["searchable", "not_searchable", "replaced"]
#: Which states an event may lead to a state from (fixed values).
ALLOWED = {"indexing": ["queued"], "completed": ["queued", "indexing"], "failed": ["queued", "indexing"]}
#: Job state of an event -> processing state.
TARGETS = {"queued": "queued", "running": "indexing", "succeeded": "completed", "failed": "failed"}
SIZES = (20, 50, 100)


def list_filter(states: list[str] | None = None, name: str | None = None, has_edition: bool | None = None, since: str | None = None, until: str | None = None) -> Column:
    """Documents of a list: not deleted; states, name, edition and upload time in [since, until)."""
    out = ~F.col("deleted")
    if states is not None:
        out = out & (F.col("state").isin(states) if states else F.lit(False))
    if name is not None:
        out = out & (F.col("name") == name)
    if has_edition is not None:
        out = out & (F.col("edition_date").isNotNull() == has_edition)
    if since:
        out = out & (F.col("uploaded_at") >= F.lit(since).cast("timestamp"))
    if until:
        out = out & (F.col("uploaded_at") < F.lit(until).cast("timestamp"))
    return out


def latest_ids(docs: DataFrame) -> DataFrame:
    """Documents with the latest edition date of their name, all ties; those without edition never."""
    newest = docs.where("edition_date is not null").groupBy("name").agg(F.max("edition_date").alias("newest"))
    return docs.join(newest, "name").where("edition_date = newest").drop("newest")


def latest_only(docs: DataFrame) -> DataFrame:
    """Documents without edition, and searchable ones of the latest searchable, undeleted edition of their name."""
    newest = docs.where("searchable and not deleted and edition_date is not null").groupBy("name").agg(F.max("edition_date").alias("newest"))
    return docs.join(newest, "name", "left").where("edition_date is null or (searchable and edition_date = newest)").drop("newest")


def visible(docs: DataFrame) -> DataFrame:
    return docs.where("not deleted and search_state <> 'replaced'")


def edition_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_others, first_id: other visible documents of each document's name and label, and the first visible one.

    What `same_edition` says of all documents at once, without their pairs.
    """
    seen = visible(docs).groupBy(F.col("name").alias("n"), F.col("label").alias("l")).agg(F.count("*").alias("c"), F.min("doc_id").alias("first_id"))
    out = docs.join(seen, docs["name"].eqNullSafe(seen["n"]) & docs["label"].eqNullSafe(seen["l"]), "left")
    mine = F.col("name").isNotNull() & ~F.col("deleted") & (F.col("search_state") != "replaced")
    return out.select("doc_id", (F.coalesce("c", F.lit(0)) - mine.cast("int")).alias("n_others"), "first_id")


def same_edition(docs: DataFrame, of: DataFrame) -> DataFrame:
    """Visible documents with the name and edition label (or both without) of another: doc_id, other_id."""
    b = of.select(F.col("doc_id").alias("other_id"), F.col("name").alias("n"), F.col("label").alias("l"))
    a = visible(docs)
    return a.join(b, (a["name"] == b["n"]) & a["label"].eqNullSafe(b["l"]) & (a["doc_id"] != b["other_id"])).select("doc_id", "other_id")


def accepts_change(kind: str, state: Column, search_state: Column, queued: Column, latest: Column) -> Column:
    """Whether a document takes a change: queue, reindex, edit or content.  Replaced ones take none."""
    settled = state.isin("completed", "failed")
    waiting = (state == "queued") & F.coalesce(queued == latest, F.lit(False))
    rule = {"queue": state == "failed", "reindex": settled, "edit": settled | waiting, "content": settled | waiting}[kind]
    return (search_state != "replaced") & rule


def target_state(job_state: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in TARGETS.items() for x in kv]), job_state)


def may_go(old: Column, new: Column) -> Column:
    out = F.lit(False)
    for target, sources in ALLOWED.items():
        out = out | ((new == target) & old.isin(sources))
    return out


def state_order(state: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATES)), state)


def sort_documents(by: Column, descending: bool) -> list[Column]:
    """The column's direction; then always updated_at falling and doc_id rising."""
    return [by.desc() if descending else by.asc(), F.col("updated_at").desc(), F.col("doc_id").asc()]


def sort_logs(by: str, descending: bool) -> list[Column]:
    turn = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    if by == "occurred_at":
        return [turn(F.col("occurred_at")), turn(F.col("log_id"))]
    return [turn(F.col(by)), F.col("occurred_at").desc(), F.col("log_id").desc()]


def sort_golden(by: Column, descending: bool) -> list[Column]:
    """Nulls last in both directions; ties by creation falling, then id."""
    return [by.desc_nulls_last() if descending else by.asc_nulls_last(), F.col("created_at").desc(), F.col("golden_set_id").asc()]


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page with the places of its rows; the total is a count of its own."""
    if number < 1 or size not in SIZES:
        raise ValueError("page from 1, size of 20, 50 or 100")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def names_after(docs: DataFrame, prefix: str, after: str, limit: int = 100) -> DataFrame:
    """Names of undeleted documents with a literal prefix, after a name: one round of a keyset page."""
    return docs.where(~F.col("deleted") & F.startswith("name", F.lit(prefix)) & (F.col("name") > after)).select("name").distinct().orderBy("name").limit(limit)


def siblings(docs: DataFrame) -> DataFrame:
    """doc_id, editions: distinct editions of the document's name among visible documents and its own, newest first; one row for each row of docs."""
    edition = F.struct(F.datediff(F.lit("9999-01-01").cast("date"), "edition_date").alias("age"), "label", F.col("edition_date").alias("d"))
    # a name's editions are collected once, not once for each of its documents
    seen = visible(docs).where("edition_date is not null").groupBy("name").agg(F.array_sort(F.collect_set(edition)).alias("seen"))
    own = F.when(F.col("edition_date").isNotNull(), F.array(edition))
    every = F.when(own.isNull() | F.array_contains("seen", own[0]), F.col("seen")).when(F.col("seen").isNull(), own).otherwise(F.array_sort(F.concat("seen", own)))
    found = docs.select("doc_id", "name", "label", "edition_date").join(seen, "name", "left")
    return found.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.transform(every, lambda x: F.struct(x["label"].alias("label"), x["d"].alias("edition_date")))).alias("editions"))


def summary_view(docs: DataFrame, versions: DataFrame, jobs: DataFrame) -> DataFrame:
    """List rows: the stage only while indexing, the failure only when failed, the queue flag only when queued."""
    failure = versions.select("doc_id", F.col("version").alias("latest_version"), "failure")
    out = docs.join(failure, ["doc_id", "latest_version"], "left").join(jobs.where("state = 'running'").select("doc_id", "stage"), "doc_id", "left")
    only = lambda state, c: F.when(F.col("state") == state, F.col(c))
    return out.select("doc_id", "name", "state", only("indexing", "stage").alias("stage"), only("failed", "failure").alias("failure"), F.when(F.col("state") == "queued", F.col("queued_version").isNotNull()).alias("queued"))


def detail_view(docs: DataFrame, versions: DataFrame, jobs: DataFrame) -> DataFrame:
    """A document's page: the list row, its file, the result only when completed, the failure only when failed.

    versions: doc_id, version, file_name, result, failure.  The view has no version column.
    """
    v = versions.select("doc_id", F.col("version").alias("latest_version"), "file_name", "result", F.col("failure").alias("__f"))
    more = docs.select("doc_id", "latest_version", "state").join(v, ["doc_id", "latest_version"])
    only = lambda state, c: F.when(F.col("state") == state, F.col(c))
    more = more.select("doc_id", "file_name", only("completed", "result").alias("result"))
    return summary_view(docs, versions, jobs).join(more, "doc_id")


#: Name of a document that is gone (fixed value).
UNKNOWN = "알 수 없는 문서"


def answer_view(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows with the name and edition of their doc_id; a name that says so where the document is unknown."""
    ref = docs.select("doc_id", F.col("name").alias("answer_name"), F.col("label").alias("answer_label"))
    return rows.join(ref, "doc_id", "left").withColumn("answer_name", F.coalesce("answer_name", F.lit(UNKNOWN)))


def log_view(rows: DataFrame) -> DataFrame:
    """Log entries as they are sent: times in whole UTC seconds, the document in a struct, nulls kept."""
    doc = F.struct("doc_id", "name", "edition_label").alias("document")
    return rows.select("log_id", tx.iso_seconds(F.col("occurred_at")).alias("occurred_at"), "kind", doc, "document_deleted", "outcome", "description")


def in_queue() -> Column:
    """Documents that wait for the next index run."""
    return F.col("queued_version").isNotNull() & ~F.col("deleted") & (F.col("search_state") != "replaced")


def to_reconcile() -> Column:
    """Documents with a request under way: queued or indexing, but no longer in the queue."""
    return F.col("queued_version").isNull() & ~F.col("deleted") & (F.col("search_state") != "replaced") & F.col("state").isin("queued", "indexing")


def names_in_scope(docs: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id of visible documents with one of the names (trimmed, repeats aside)."""
    return visible(docs).join(names.select(F.trim("name").alias("name")).distinct(), "name", "left_semi").select("doc_id")


def work_queue(docs: DataFrame) -> DataFrame:
    """Documents by what has to be done for them: state and number."""
    return docs.where("not deleted").groupBy("state").agg(F.count("*").alias("n"))


def log_filter(kinds: list[str] | None = None, outcome: str | None = None, first_day: str | None = None, last_day: str | None = None, name: str | None = None, doc_id: str | None = None) -> Column:
    """Korean days, both ends included."""
    out = F.lit(True)
    if kinds is not None:
        out = out & (F.col("kind").isin(kinds) if kinds else F.lit(False))
    for c, v in (("outcome", outcome), ("name", name), ("doc_id", doc_id)):
        if v is not None:
            out = out & (F.col(c) == v)
    if first_day:
        out = out & (F.col("occurred_at") >= tx.kst_day(F.lit(first_day))[0])
    if last_day:
        out = out & (F.col("occurred_at") < tx.kst_day(F.lit(last_day))[1])
    return out


def with_deleted_flag(rows: DataFrame, logs: DataFrame) -> DataFrame:
    """document_deleted: the document has a delete log, whatever its outcome."""
    gone = logs.where("kind = 'delete'").select("doc_id").distinct().withColumn("document_deleted", F.lit(True))
    return rows.join(gone, "doc_id", "left").withColumn("document_deleted", F.coalesce("document_deleted", F.lit(False)))


def kept_logs(logs: DataFrame, now: Column, days: int = 90) -> DataFrame:
    return logs.where(F.col("occurred_at") > now - F.make_dt_interval(F.lit(days)))


#: Sentences of logs by kind: success, failure (fixed values).
SENTENCES = {
    "upload": ("문서를 올렸습니다", "문서를 올리지 못했습니다"),
    "content_upload": ("내용을 다시 올렸습니다", "내용을 다시 올리지 못했습니다"),
    "delete": ("문서를 삭제했습니다", "문서 삭제를 마치지 못했습니다"),
    "replace": ("같은 판의 다른 문서로 교체됐습니다", "같은 판의 다른 문서로 교체됐습니다"),
}


def describe(kind: Column, outcome: Column, fields: Column, made: Column, temporary: Column) -> Column:
    """A log's sentence; edits name their fields, captioning its counts (0 for what is no count)."""
    ok = outcome == "success"
    out = F.lit(None).cast("string")
    for k, (good, bad) in SENTENCES.items():
        out = F.when(kind == k, F.when(ok, good).otherwise(bad)).otherwise(out)
    count = lambda c: F.when((c >= 0) & (c < 2**53), c.cast("bigint").cast("string")).otherwise("0")
    caption = F.concat(F.lit("요약·캡션 "), count(made), F.lit("개를 만들었습니다 (임시 설명 "), count(temporary), F.lit("개)"))
    out = F.when(kind == "captioning", F.when(ok, caption).otherwise("요약·캡션을 만들지 못했습니다")).otherwise(out)
    named = F.coalesce(fields, F.lit("항목"))
    return F.when(kind == "edit", F.concat(tx.particle(named, "을", "를"), F.when(ok, " 고쳤습니다").otherwise(" 고치지 못했습니다"))).otherwise(out)


def in_request_order(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """pos, doc_id and the row of each asked id, repeats included; unknown ids give nulls.  ids: pos, doc_id."""
    return ids.join(rows, "doc_id", "left").orderBy("pos")


def wire(row: Column) -> Column:
    """JSON with an explicit null for what is missing."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def unwire(body: Column, schema: str) -> Column:
    """A struct of a JSON body with snake_case keys; missing keys are null, other keys are left out.

    A body that is no JSON object gives null.
    """
    return F.when(F.json_object_keys(body).isNotNull(), F.from_json(body, schema))
