"""Text functions as Column expressions; what Spark has no function for is an Arrow UDF.

Placeholders: `[[<namespace>:<table|image>:<id> | <description>]]`.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMESPACE = "asset"
#: JavaScript white space (fixed values): not U+0085, U+001C-1F or U+200B.
JS_SPACE = r"[\t\n\x0B\f\r    -     　﻿]"
#: Python str.split white space (fixed values).
PY_SPACE = r"[\t-\r\x1c-\x20\x85   -     　]"
HANGUL = r"[가-힣]+"
WORD = r"[\p{L}\p{N}]+"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode normal form KC; null stays null."""
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode normal form C; null stays null."""
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; the underscore separates."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def hangul_pairs(word: Column) -> Column:
    """Two-letter pieces of each Hangul run of a word, without the word itself."""
    runs = F.regexp_extract_all(word, F.lit(HANGUL), F.lit(0))
    pieces = F.transform(F.filter(runs, lambda r: F.length(r) > 1), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2))))
    return F.filter(F.flatten(pieces), lambda p: p != word)


def terms(text: Column) -> Column:
    """Keyword terms of a text: its words and their Hangul pairs, with repeats."""
    plain = words(text)
    # looking into each word costs most of the time, and texts without Hangul have no pairs
    return F.when(text.rlike(HANGUL), F.flatten(F.transform(plain, lambda w: F.concat(F.array(w), hangul_pairs(w))))).otherwise(plain)


def strict_placeholder(namespace: str = NAMESPACE) -> str:
    """Pattern with a non-empty one-line description that does not end in ]."""
    return rf"\[\[{namespace}:(table|image):([A-Za-z0-9_-]+) \| ((?:(?!\]\])[^\n\r])*(?:(?!\]\])[^\n\r\]]))\]\]"


def loose_placeholder(namespace: str = NAMESPACE) -> str:
    """Pattern of restoration: the description may be empty."""
    return rf"\[\[{namespace}:(table|image):([A-Za-z0-9_-]+) \| ((?:(?!\]\])[^\n\r])*)\]\]"


def placeholder_ids(text: Column, namespace: str = NAMESPACE) -> Column:
    return F.regexp_extract_all(text, F.lit(strict_placeholder(namespace)), F.lit(2))


def placeholder(kind: Column, ident: Column, description: Column, namespace: str = NAMESPACE) -> Column:
    return F.concat(F.lit(f"[[{namespace}:"), kind, F.lit(":"), ident, F.lit(" | "), description, F.lit("]]"))


def guard(text: Column, namespace: str = NAMESPACE) -> Column:
    """Breaks look-alike placeholders by one zero-width space; guard of guarded text adds another."""
    return F.regexp_replace(text, rf"\[(​*)\[{namespace}:", "[​$1[" + namespace + ":")


def unguard(text: Column, namespace: str = NAMESPACE) -> Column:
    return F.regexp_replace(text, rf"\[​(​*)\[{namespace}:", "[$1[" + namespace + ":")


def clean_description(text: Column, fallback: str) -> Column:
    """One line without ]] or trailing ]; the fallback if no letter or digit is left."""
    one = F.replace(F.regexp_replace(text, r"[\r\n]+", " "), F.lit("]]"), F.lit(" "))
    out = F.regexp_replace(F.trim(F.regexp_replace(one, JS_SPACE + "+", " ")), r"[\]\s]+$", "")
    return F.when(out.rlike(r"[\p{L}\p{N}]"), out).otherwise(F.lit(fallback))


def escape_alt(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(F.replace(out, F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))
    return F.regexp_replace(out, r"[\r\n]+", " ")


def image_url(base: str, doc: Column, ident: Column) -> Column:
    part = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit(base.rstrip("/") + "/"), part(doc), F.lit("/"), part(ident))


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, JS_SPACE, "")


def glossary_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(nfkc(text)), PY_SPACE + "+", " "))


def bounded(text: Column, word: Column) -> Column:
    """Whether word occurs in text, not inside a longer run of ASCII letters or digits."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    left = F.when(word.rlike("^[A-Za-z0-9]"), "(?<![A-Za-z0-9])").otherwise("")
    right = F.when(word.rlike("[A-Za-z0-9]$"), "(?![A-Za-z0-9])").otherwise("")
    return F.regexp_like(text, F.concat(left, quoted, right))


def span_in_one_zone(markdown: Column, span: Column, namespace: str = NAMESPACE) -> Column:
    """Whether the answer span lies inside one part between placeholders, white space aside."""
    zones = F.split(markdown, loose_placeholder(namespace))
    needle = strip_space(span)
    return (needle != "") & F.exists(zones, lambda z: F.contains(strip_space(z), needle))


def kst_day(day: Column) -> tuple[Column, Column]:
    """UTC start and end of a Korean day (fixed +9 h) given as yyyy-MM-dd; null if there is no such day."""
    start = F.to_timestamp(F.try_to_date(F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day), "yyyy-MM-dd")) - F.expr("INTERVAL 9 HOURS")
    return start, start + F.expr("INTERVAL 24 HOURS")


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def next_version(v: Column) -> Column:
    return (v.cast("bigint") + 1).cast("string")


def previous_version(v: Column) -> Column:
    return F.when(v.cast("bigint") > 1, (v.cast("bigint") - 1).cast("string"))


def newer(a: Column, b: Column) -> Column:
    """Numeric comparison of versions."""
    return a.cast("bigint") > b.cast("bigint")


def byte_size(n: Column) -> Column:
    """MB or KB where exact, else bytes."""
    return F.when(n % (1 << 20) == 0, F.concat((n / (1 << 20)).cast("bigint"), F.lit("MB"))).when(n % 1024 == 0, F.concat((n / 1024).cast("bigint"), F.lit("KB"))).otherwise(F.concat(n, F.lit("B")))


def has_final(word: Column) -> Column:
    """Whether the last letter is a Hangul syllable with a final consonant."""
    code = F.ascii(F.right(word, F.lit(1)))
    return code.between(0xAC00, 0xD7A3) & ((code - 0xAC00) % 28 > 0)


def particle(word: Column, with_final: str, without: str) -> Column:
    return F.concat(word, F.when(has_final(word), with_final).otherwise(without))


def base_name(path: Column) -> Column:
    return F.substring_index(F.replace(F.regexp_extract(path, r"^[^?#]*", 0), F.lit("\\"), F.lit("/")), "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))


def content_type(path: Column) -> Column:
    """Content type of an image path, null for others."""
    kinds = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp"}
    return F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), extension(path))


def drop_thinking(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)^\s*<think>.*?</think>", ""))


def displayed_table(markdown: Column) -> Column:
    """Quote and list prefixes removed from the second line on."""
    return F.array_join(F.transform(F.split(markdown, "\n"), lambda x, i: F.when(i == 0, x).otherwise(F.regexp_replace(x, r"^(?:[ \t]*(?:>|[-*+][ \t]|\d+[.)][ \t]))*[ \t]*(?=\|)", ""))), "\n")


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]*>", "")


def normal_lines(text: Column) -> Column:
    """LF line ends, no leading byte order mark, NUL replaced."""
    return F.replace(F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n"), F.lit("\x00"), F.lit("�"))


def numbered_lines(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit("| "), x)), "\n")


def checksum(markdown: Column, assets: Column, mode: Column, max_tokens: Column, model: Column) -> Column:
    """Hash of what an index depends on; assets is an array and is sorted."""
    payload = F.struct(F.array_sort(assets).alias("assets"), max_tokens.alias("chunk_max_tokens"), model.alias("embedding_model"), markdown.alias("markdown"), mode.alias("mode"), F.lit(1).alias("v"))
    return F.sha2(F.to_json(payload), 256)


def index_decision(checksum_: Column, open_job: Column, current_job: Column, current_checksum: Column, force: Column) -> Column:
    """join an open job, reuse an equal index, or submit."""
    same = ~F.coalesce(force, F.lit(False)) & current_job.isNotNull() & current_checksum.eqNullSafe(checksum_)
    return F.when(open_job.isNotNull(), "join").when(same, "reuse").otherwise("submit")


#: Terms whose numbers are remembered at once.
KNOWN_TERMS = 100_000


class KnownNumbers(dict):
    """32-bit numbers of terms; a term is hashed once for `KNOWN_TERMS` others."""

    def __missing__(self, t: str) -> int:
        if len(self) >= KNOWN_TERMS:
            self.clear()
        self[t] = number = int.from_bytes(blake2b(t.encode("utf-8"), digest_size=4).digest(), "big")
        return number


@F.pandas_udf(T.LongType())
def term_number(term: pd.Series) -> pd.Series:
    """A term's 32-bit number, for stores that know terms by number: different terms may share one."""
    known = {t: int.from_bytes(blake2b(t.encode("utf-8"), digest_size=4).digest(), "big") for t in term.dropna().unique()}
    return term.map(known).astype("Int64")


@F.pandas_udf(T.ArrayType(T.LongType()))
def term_numbers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The numbers of arrays of terms, with repeats; a term is hashed once for a task, or `KNOWN_TERMS` others."""
    known = KnownNumbers()
    for terms_ in batches:
        yield terms_.map(lambda x: None if x is None else [known[t] for t in x])


class Automaton:
    """Suffix automaton of a text: all its substrings in space linear in its length."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size, self.end = [-1], [0], [-1]
        last = 0
        for i, ch in enumerate(text):
            new = self._state({}, self.size[last] + 1, i)
            p = last
            while p >= 0 and ch not in self.next[p]:
                self.next[p][ch] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            else:
                q = self.next[p][ch]
                if self.size[q] > self.size[p] + 1:
                    twin = self._state(dict(self.next[q]), self.size[p] + 1, self.end[q])
                    self.link[twin], self.link[q] = self.link[q], twin
                    while p >= 0 and self.next[p].get(ch) == q:
                        self.next[p][ch] = twin
                        p = self.link[p]
                    q = twin
                self.link[new] = q
            last = new

    def _state(self, following: dict[str, int], size: int, end: int) -> int:
        self.next.append(following)
        self.link.append(0)
        self.size.append(size)
        self.end.append(end)
        return len(self.size) - 1

    def longest_in(self, body: str) -> tuple[int, int]:
        """Where in the text its longest substring that body holds first begins, and its length."""
        state, size, best = 0, 0, (0, 0)
        for ch in body:
            while state and ch not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            if ch in self.next[state]:
                state, size = self.next[state][ch], size + 1
                best = min(best, (-size, self.end[state] - size + 1))
        return (best[1], -best[0]) if best[0] else (0, 0)


def longest_common(span: str, body: str) -> tuple[int, int]:
    """Start in span and length of the longest common substring, the first on ties."""
    return Automaton(span).longest_in(body)


@F.pandas_udf(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("size", T.IntegerType())]))
def common_span(span: pd.Series, body: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([longest_common(a or "", b or "") for a, b in zip(span, body, strict=True)], columns=["start", "size"])
