"""Scalar functions, parsers and views over the driver's tables, each beside its SQL."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nested
from ..functions import text as tx
from ..operators import assets as at
from ..operators import catalog as cat
from ..operators import chunking as ck
from ..operators import evaluation as ev
from ..operators import glossary as gl
from ..operators import retrieval as rt
from ..operators import versions as vs
from ..sources.store import spread, text_parts_of
from .base import query
from .corpus import table

c = F.col


def scalar(name: str, source: str, key: str, columns: dict[str, tuple[Callable[[], Column], str]], where: str | None = None) -> None:
    """Registers key and the columns of a table; each column is given for Spark and in SQL."""
    sql = f"SELECT {key}, {', '.join(f'{s} AS {n}' for n, (_, s) in columns.items())} FROM {source}"

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, source)
        return (rows.where(where) if where else rows).select(key, *[e().alias(n) for n, (e, _) in columns.items()])

    query(name, sql + (f" WHERE {where}" if where else ""))(run)


MARK = "'[[asset:table:t' || item_id || ' | d' || item_id || ']] '"


def mark() -> Column:
    return F.concat(F.lit("[[asset:table:t"), c("item_id").cast("string"), F.lit(" | d"), c("item_id").cast("string"), F.lit("]] "))


ID = "CAST({} AS VARCHAR)"

scalar("x01_placeholders", "benchmark", "item_id", {
    "ids": (lambda: tx.placeholder_ids(F.concat(mark(), c("text"), mark())), "['t' || item_id, 't' || item_id]"),
    "zones": (lambda: F.size(F.split(F.concat(mark(), c("text"), mark()), tx.loose_placeholder())), "3"),
})
scalar("x03_format_placeholder", "benchmark", "item_id", {"placeholder": (lambda: tx.placeholder(F.lit("table"), F.concat(F.lit("t"), c("item_id").cast("string")), c("text")), "'[[asset:table:t' || item_id || ' | ' || text || ']]'")})
scalar("x04_guard", "benchmark", "item_id", {
    "guarded": (lambda: tx.guard(mark()), f"replace({MARK}, '[[asset:', '[' || chr(8203) || '[asset:')"),
    "back": (lambda: tx.unguard(tx.guard(tx.guard(mark()))), f"replace({MARK}, '[[asset:', '[' || chr(8203) || '[asset:')"),
})
scalar("x05_clean_description", "pages", "page_id", {"description": (lambda: tx.clean_description(F.concat(F.lit(" a]]\n"), c("url"), F.lit(" ]] ")), "none"), "'a ' || url")})
scalar("x06_escape_alt", "nation", "n_nationkey", {"alt": (lambda: tx.escape_alt(F.concat(F.lit("["), c("n_name"), F.lit("\\]\n"))), "'\\[' || n_name || '\\\\\\] '")})
scalar("x07_image_url", "part", "p_partkey", {"url": (lambda: tx.image_url("https://files.example/", c("p_partkey").cast("string"), c("p_name")), "'https://files.example/' || p_partkey || '/' || url_encode(p_name)")})
scalar("x08_strip_space", "documents", "doc_id", {"body": (lambda: tx.strip_space(c("text")), r"regexp_replace(text, '\s', '', 'g')")})
scalar("x10_bounded", "documents", "doc_id", {w: (lambda w=w: tx.bounded(c("text"), F.lit(w)), rf"coalesce(regexp_matches(text, '(^|[^A-Za-z0-9]){w}($|[^A-Za-z0-9])'), NULL)") for w in ("de", "la", "the")})
scalar("x16_index_decision", "orders", "o_orderkey", {"decision": (
    lambda: tx.index_decision(c("o_orderpriority"), F.when(c("o_orderkey") % 5 == 0, "j"), F.when(c("o_orderkey") % 3 > 0, "k"), F.when(c("o_orderkey") % 2 == 0, c("o_orderpriority")), c("o_orderkey") % 7 == 0),
    "CASE WHEN o_orderkey % 5 = 0 THEN 'join' WHEN o_orderkey % 7 <> 0 AND o_orderkey % 3 > 0 AND o_orderkey % 2 = 0 THEN 'reuse' ELSE 'submit' END",
)})
scalar("x17_span_in_zone", "benchmark", "item_id", {
    "inside": (lambda: tx.span_in_one_zone(F.concat(c("text"), mark()), F.left("text", F.lit(30))), "true"),
    "across": (lambda: tx.span_in_one_zone(F.concat(F.left("text", F.lit(9)), mark(), F.substr("text", F.lit(10))), c("text")), "false"),
})
scalar("x19_kst_day", "orders", "o_orderkey", {"start": (lambda: F.date_format(tx.kst_day(F.date_format("o_orderdate", "yyyy-MM-dd"))[0], "yyyy-MM-dd HH:mm"), "strftime(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M')")})
scalar("x20_iso_seconds", "events", "event_id", {"at": (lambda: tx.iso_seconds(c("ts")), "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')")})
scalar("x22_versions", "lineitem", "l_orderkey", {
    "l_linenumber": (lambda: c("l_linenumber"), "l_linenumber"),
    "after": (lambda: tx.next_version(c("l_linenumber").cast("string")), ID.format("l_linenumber + 1")),
    "before": (lambda: tx.previous_version(c("l_linenumber").cast("string")), f"CASE WHEN l_linenumber > 1 THEN {ID.format('l_linenumber - 1')} END"),
    "newer": (lambda: tx.newer(c("l_linenumber").cast("string"), F.lit("3")), "l_linenumber > 3"),
})
scalar("x23_byte_size", "part", "p_partkey", {"size": (lambda: tx.byte_size(c("p_partkey") * 4096 + c("p_size") % 2), "CASE WHEN (p_partkey * 4096 + p_size % 2) % 1048576 = 0 THEN (p_partkey * 4096 + p_size % 2) // 1048576 || 'MB' WHEN (p_partkey * 4096 + p_size % 2) % 1024 = 0 THEN (p_partkey * 4096 + p_size % 2) // 1024 || 'KB' ELSE (p_partkey * 4096 + p_size % 2) || 'B' END")})
scalar("x24_particle", "part", "p_partkey", {"word": (lambda: tx.particle(F.element_at(F.array(*map(F.lit, "가각나난다닫A")), (c("p_partkey") % 7 + 1).cast("int")), "을", "를"), "['가를', '각을', '나를', '난을', '다를', '닫을', 'A를'][p_partkey % 7 + 1]")})
scalar("x26_path_parts", "pages", "page_id", {
    "name": (lambda: tx.base_name(F.concat(c("url"), F.lit("/a%20b.PNG?x=/1"))), r"regexp_extract(regexp_extract(url || '/a%20b.PNG?x=/1', '^[^?#]*'), '[^/\\]*$')"),
    "ext": (lambda: tx.extension(F.concat(c("url"), F.lit("/a%20b.PNG?x=/1"))), r"lower(regexp_extract(regexp_extract(regexp_extract(url || '/a%20b.PNG?x=/1', '^[^?#]*'), '[^/\\]*$'), '\.([^.]+)$', 1))"),
    "type": (lambda: tx.content_type(F.concat(c("url"), F.lit("/a%20b.PNG?x=/1"))), "CASE WHEN regexp_extract(url, '[?#]') = '' THEN 'image/png' END"),
})
scalar("x27_code_points", "documents", "doc_id", {"n": (lambda: F.char_length("text"), "length(text)")})
scalar("x29_drop_thinking", "conversations", "conv_id", {"turn": (lambda: c("turn"), "turn"), "answer": (lambda: tx.drop_thinking(F.concat(F.lit("<think>\n"), c("role"), F.lit("</think> "), c("role"))), "role")})
scalar("x31_numbered_lines", "documents", "doc_id", {"prompt": (lambda: tx.numbered_lines(c("text")), "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: i || '| ' || x), chr(10))")})
scalar("x32_displayed_table", "nation", "n_nationkey", {"shown": (lambda: tx.displayed_table(F.concat(F.lit("| "), c("n_name"), F.lit(" |\n> | - |\n  - > | 1 |"))), "'| ' || n_name || ' |' || chr(10) || '| - |' || chr(10) || '| 1 |'")})
scalar("c17_strip_tags", "pages", "page_id", {"text": (lambda: tx.strip_tags(c("html")), "regexp_replace(html, '<[^>]*>', '', 'g')")})
scalar("c18_normal_lines", "documents", "doc_id", {"text": (lambda: tx.normal_lines(F.replace(c("text"), F.lit("\n"), F.lit("\r\n"))), "replace(replace(replace(replace(text, chr(10), chr(13) || chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(0), chr(65533))")})
scalar("p09_new_asset", "lineitem", "l_orderkey", {
    "l_linenumber": (lambda: c("l_linenumber"), "l_linenumber"),
    "status": (lambda: at.new_status(F.when(c("l_linenumber") > 3, "t1"), F.when(c("l_returnflag") == "N", "image").otherwise("table")), "CASE WHEN l_returnflag = 'N' AND l_linenumber > 3 THEN 'done' ELSE 'pending' END"),
})
scalar("f14_accepts_change", "orders", "o_orderkey", {
    kind: (
        lambda kind=kind: cat.accepts_change(kind, F.when(c("o_orderkey") % 3 == 0, "failed").when(c("o_orderkey") % 3 == 1, "queued").otherwise("indexing"), F.when(c("o_orderkey") % 5 == 0, "replaced").otherwise("searchable"), F.when(c("o_orderkey") % 2 == 0, "2"), F.lit("2")),
        f"o_orderkey % 5 <> 0 AND (o_orderkey % 3 = 0{' OR o_orderkey % 3 = 1 AND o_orderkey % 2 = 0' if kind in ('edit', 'content') else ''})",
    )
    for kind in ("queue", "reindex", "edit", "content")
})
scalar("f14_may_go", "orders", "o_orderkey", {
    f"to_{new}": (
        lambda new=new: cat.may_go(F.element_at(F.array(*map(F.lit, cat.STATES)), (c("o_orderkey") % 6 + 1).cast("int")), F.lit(new)),
        f"o_orderkey % 6 {old}",
    )
    for new, old in (("queued", "> 9"), ("indexing", "= 2"), ("completed", "IN (2, 3)"), ("failed", "IN (2, 3)"))
})
scalar("p06_wire", "customer", "c_custkey", {"body": (lambda: cat.wire(F.struct("c_custkey", F.when(c("c_custkey") % 2 == 0, c("c_name")).alias("name"))), "json_object('c_custkey', c_custkey, 'name', CASE WHEN c_custkey % 2 = 0 THEN c_name END)")})
scalar("p07_unwire", "events", "event_id", {"k": (lambda: cat.unwire(c("props"), "k bigint, gone string")["k"], "CAST(json_extract(props, '$.k') AS BIGINT)"), "gone": (lambda: cat.unwire(c("props"), "k bigint, gone string")["gone"], "CAST(NULL AS VARCHAR)")})
scalar("x25_log_sentence", "orders", "o_orderkey", {"sentence": (
    lambda: cat.describe(F.when(c("o_orderkey") % 2 == 0, "edit").otherwise("captioning"), F.when(c("o_orderkey") % 3 == 0, "failure").otherwise("success"), F.lit("이름"), c("o_orderkey"), F.lit(-1)),
    "CASE WHEN o_orderkey % 2 = 0 THEN '이름을 ' || CASE WHEN o_orderkey % 3 = 0 THEN '고치지 못했습니다' ELSE '고쳤습니다' END WHEN o_orderkey % 3 = 0 THEN '요약·캡션을 만들지 못했습니다' ELSE '요약·캡션 ' || o_orderkey || '개를 만들었습니다 (임시 설명 0개)' END",
)})
scalar("x15_checksum", "benchmark", "item_id", {"checksum": (
    lambda: tx.checksum(c("text"), F.array(F.lit("b"), F.lit("a")), F.lit("rule"), F.lit(256), F.lit("m")),
    "sha256('{\"assets\":[\"a\",\"b\"],\"chunk_max_tokens\":256,\"embedding_model\":\"m\",\"markdown\":' || to_json(text) || ',\"mode\":\"rule\",\"v\":1}')",
)})
scalar("m16_outcome", "orders", "o_orderkey", {"outcome": (lambda: ev.outcome_of(c("o_orderkey") % 2 == 0, F.when(c("o_orderkey") % 5 == 0, "e")), "CASE WHEN o_orderkey % 5 = 0 THEN 'error' WHEN o_orderkey % 2 = 0 THEN 'hit' ELSE 'miss' END")})
scalar("m22_stop_reason", "orders", "o_orderkey", {"reason": (
    lambda: vs.stop_reason(*[c("o_orderkey") % n == 0 for n in (13, 7, 5, 3, 2)]),
    "CASE WHEN o_orderkey % 13 = 0 THEN 'shutdown' WHEN o_orderkey % 7 = 0 THEN 'deleted' WHEN o_orderkey % 5 = 0 THEN 'replaced' WHEN o_orderkey % 3 = 0 THEN 'superseded' WHEN o_orderkey % 2 = 0 THEN 'state_changed' END",
)})
scalar("m28_failure_code", "orders", "o_orderkey", {"code": (lambda: vs.failure_code(F.when(c("o_orderkey") % 2 == 0, "STORE_UNAVAILABLE").when(c("o_orderkey") % 3 == 0, "ODD")), "CASE WHEN o_orderkey % 2 = 0 THEN 'STORE_UNAVAILABLE' ELSE 'INTERNAL_ERROR' END")})



#: Words whose tokens are remembered at once.
KNOWN_WORDS = 500_000
#: The words of byte-level tokenizers, over texts whose characters beyond ASCII are replaced by one of their class.
_BYTE_LEVEL = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


def token_counter(path: str):
    """Counts the tokens of a text by a tokenizer file, without special tokens.

    A word that a byte-level tokenizer splits off has the same tokens wherever it stands, so each
    is encoded once and then looked up.  Texts that hold an added token, and all texts of other
    tokenizers, are encoded whole.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    whole = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    set_up = json.loads(tokenizer.to_str())
    split = set_up["pre_tokenizer"] or {}
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex") or any(set_up.get(k) for k in ("normalizer", "truncation", "padding")):
        return whole
    added = [t["content"] for t in set_up["added_tokens"]]
    pieces = lambda text: len(tokenizer.pre_tokenizer.pre_tokenize_str(text))

    class Classes(dict):
        def __missing__(self, code: int) -> str:
            ch = chr(code)
            self[code] = ch if code < 128 else next((like for like in "a1!" if pieces(like + ch) == 1), "\t")
            return self[code]

    class Sizes(dict):
        def __missing__(self, word: str) -> int:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = whole(word)
            return self[word]

    classes, sizes = Classes(), Sizes()

    def count(text: str) -> int:
        if any(t in text for t in added):
            return whole(text)
        words = _BYTE_LEVEL.findall(text) if text.isascii() else [text[m.start() : m.end()] for m in _BYTE_LEVEL.finditer(text.translate(classes))]
        return sum(map(sizes.__getitem__, words))

    return count


GLOSSARY = [["de", "von", "del"], ["market", "trade"]]


@query("x11_expand_queries")
def x11(spark, d):
    """keyword_text and sentence of the benchmark texts; a small fixture is tested by hand."""
    words = spark.createDataFrame(gl.checked(GLOSSARY), "group_no int, pos int, word string, norm string")
    return gl.expand(table(spark, d, "benchmark"), words, "item_id", "text")


@query("x18_common_span")
def x18(spark, d):
    """Longest common substring of neighbouring benchmark texts; tested against all substrings."""
    b = table(spark, d, "benchmark")
    other = b.select((c("item_id") + 1).alias("item_id"), c("text").alias("other"))
    found = b.join(other, "item_id").select("item_id", tx.common_span("text", "other").alias("s"))
    return found.select("item_id", "s.start", "s.size")


@query("x30_parsed_boundaries", """SELECT item_id, CASE item_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'line_out_of_range' WHEN 2 THEN 'empty_title' WHEN 3 THEN 'bad_item' ELSE 'not_json' END AS fault FROM benchmark""")
def x30(spark, d):
    b = table(spark, d, "benchmark").withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    item = lambda end, title: f'{{"chunks": [{{"start_line": 1, "end_line": {end}, "title": "{title}", "summary": "s"}}]}}'
    made = F.element_at(F.array(*map(F.lit, [item("1", "t"), item("9", "t"), item("1", " "), item("true", "t"), "no"])), (c("item_id") % 5 + 1).cast("int"))
    return ck.parsed_boundaries(b.withColumn("response", made)).select("item_id", "fault")


@query("c01_chunks")
def c01(spark, d):
    """Rule chunks of all documents at 256 words; tested on Markdown fixtures."""
    return ck.chunk(table(spark, d, "documents"), "doc_id", "text")


@query("c13_chunk_counts", r"""WITH n AS (SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))) AS BIGINT) AS n FROM documents)
SELECT doc_id, n + 1 AS n_text, CAST(1 AS BIGINT) AS n_asset, CASE WHEN n > 0 THEN true ELSE false END AS path_kept FROM n""")
def c13(spark, d):
    """Whole texts as Markdown, each line with a heading of its own, and a placeholder at the end."""
    lines_ = F.transform(F.split(F.coalesce(c("text"), F.lit("")), "\n"), lambda x: F.concat(F.lit("## B\n\n"), x))
    md = table(spark, d, "documents").select("doc_id", F.concat(F.lit("# A\n\n"), F.array_join(lines_, "\n\n"), F.lit("\n\n## C\n\n[[asset:table:t1 | x]]")).alias("text"))
    made = ck.chunk(md, "doc_id", "text", 1 << 30)
    return made.groupBy("doc_id").agg(F.count_if(c("kind") == "text").alias("n_text"), F.count_if(c("kind") == "asset").alias("n_asset"), F.bool_or(F.array_join("heading_path", ">") == "A>B").alias("path_kept"))


@query("c06_token_chunks")
def c06(spark, d):
    """Whole texts in chunks of at most 128 tokens of a public vocabulary; tested against cuts one by one."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return ck.chunk(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", 128, load_measure=lambda: token_counter(path)).select("doc_id", "chunk_key", "split_index", "text")


@query("c15_extracted_assets", "SELECT doc_id, 2 AS n, 'a/' || doc_id || '.png' AS path FROM documents")
def c15(spark, d):
    """Whole texts after a table and an image."""
    md = table(spark, d, "documents").select("doc_id", F.concat(F.lit("| a | b |\n| - | - |\n| 1 | 2 |\n\n![alt](a/"), F.col("doc_id").cast("string"), F.lit(".png)\n\n"), F.coalesce("text", F.lit(""))).alias("text"))
    made = at.extract_assets(md, "doc_id", "text")
    return made.select("doc_id", F.size("assets").alias("n"), F.element_at("assets", -1)["path"].alias("path"))


@query("x28_redacted", "SELECT event_id, '[redacted]' AS user_id, '[redacted]' AS token, value, '[redacted]' AS in_map, event_type AS kept FROM events")
def x28(spark, d):
    """Events with a nested record and a map, without the names that logs must not hold."""
    e = table(spark, d, "events")
    rows = e.select("event_id", c("user_id").alias("User_Id"), F.array(F.struct(c("props").alias("token"), "value")).alias("items"), F.create_map(F.lit("token"), c("props"), F.lit("kind"), c("event_type")).alias("m"))
    out = nested.without_secrets(rows, ["token", "user_id"])
    return out.select("event_id", c("User_Id").alias("user_id"), F.get("items", F.lit(0))["token"].alias("token"), F.get("items", F.lit(0))["value"].alias("value"), c("m")["token"].alias("in_map"), c("m")["kind"].alias("kept"))


@query("p08_payload_round_trip", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def p08(spark, d):
    """Records as payloads and back."""
    rows = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return nested.from_payload(nested.to_payload(rows, "doc_id"), "doc_id", rows.schema)


@query("k04_term_numbers")
def k04(spark, d):
    """Term frequencies by 32-bit number, where terms that share one are counted together; tested against hashlib."""
    texts = table(spark, d, "documents").select("doc_id", "text")
    return rt.numbered_postings(texts, "doc_id", "text", text_parts_of(texts))
