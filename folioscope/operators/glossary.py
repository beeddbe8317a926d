"""Glossary: groups of words that mean the same; query expansion and canonical rewriting."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a glossary that may go to all executors.
GLOSSARY_BYTES = 16 << 20


def normal(word: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", word).lower().split())


def checked(groups: list[list[str]]) -> list[tuple[int, int, str, str]]:
    """(group, position, word, normal form); groups have two words or more, no word occurs twice."""
    out, seen = [], set()
    if not isinstance(groups, list):
        raise ValueError("a glossary is a list of groups")
    for g, words in enumerate(groups):
        if not isinstance(words, list) or len(words) < 2:
            raise ValueError("a group is a list of two words or more")
        for p, w in enumerate(words):
            if not isinstance(w, str) or not normal(w) or normal(w) in seen:
                raise ValueError(f"bad or repeated word: {w!r}")
            seen.add(normal(w))
            out.append((g, p, w, normal(w)))
    return out


class Glossary:
    """A glossary file, read again when it changes; a faulty file leaves the last good one in place."""

    def __init__(self, path: str) -> None:
        self.path, self.mark, self.rows = Path(path), None, []

    def _parse(self) -> list[list[str]]:
        groups = []
        for line in self.path.read_text("utf-8").splitlines():
            line = line.split("#")[0].strip()
            if m := re.fullmatch(r"-\s*\[(.*)\]", line):
                groups.append([w.strip().strip("\"'") for w in m[1].split(",")])
            elif line and line != "groups:":
                raise ValueError(f"not a glossary line: {line}")
        return groups

    def table(self, spark: SparkSession) -> DataFrame:
        """group_no, pos, word, norm."""
        stat = self.path.stat()
        mark = (stat.st_mtime_ns, stat.st_size)
        if mark != self.mark:
            try:
                self.rows, self.mark = checked(self._parse()), mark
            except (ValueError, OSError):
                if self.mark is None:
                    raise
        return spark.createDataFrame(self.rows, "group_no int, pos int, word string, norm string")


class Automaton:
    """All words of a glossary as one automaton over normal forms, and what each match stands for."""

    def __init__(self, rows: list[tuple[int, int, str, str]]) -> None:
        """rows: (group, position, word, normal form)."""
        self.groups: dict[int, list[tuple[int, str, str]]] = {}
        for group, pos, word, norm in rows:
            self.groups.setdefault(group, []).append((pos, word, norm))
        self.trie, of = ahocorasick.Automaton(), {}
        for group, words in self.groups.items():
            words.sort()
            for _, _, norm in words:
                if norm:
                    of.setdefault(norm, []).append(group)
        for norm, groups in of.items():
            self.trie.add_word(norm, (len(norm), norm, sorted(groups), _inner(norm[0]), _inner(norm[-1])))
        if of:
            self.trie.make_automaton()
        self.any = bool(of)

    def matches(self, text: str) -> list[tuple[int, int, str, list[int]]]:
        """(start, end, normal form, groups) of all words in a normal form of a text, overlapping ones too.

        A word that begins or ends with an ASCII letter or digit doesn't match inside a longer run of them.
        """
        out = []
        for last, (size, norm, groups, inner_left, inner_right) in self.trie.iter(text) if self.any else ():
            a, b = last + 1 - size, last + 1
            if not (inner_left and a and _inner(text[a - 1])) and not (inner_right and b < len(text) and _inner(text[b])):
                out.append((a, b, norm, groups))
        return out

    def expanded(self, query: str) -> tuple[str, str]:
        """keyword text and sentence of a query."""
        text = normal(query)
        found = self.matches(text)
        if not found:
            return query, query
        held = {norm for _, _, norm, _ in found}
        more = [word for group in sorted({g for *_, groups in found for g in groups}) for _, word, norm in self.groups[group] if norm not in held]
        first = {g: next((w for p, w, _ in self.groups[g] if p == 0), None) for *_, groups in found for g in groups}
        spans = [(a, b, first[g]) for a, b, _, groups in found for g in groups if first[g] is not None]
        return " ".join([query, *more]), replaced(text, spans)


def _inner(char: str) -> bool:
    return char.isascii() and char.isalnum()


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with spans replaced: the longest first, then earlier ones; none that overlaps one taken before."""
    starts: list[int] = []
    taken: list[tuple[int, int, str]] = []
    for a, b, word in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
        k = bisect_left(starts, a)
        if (not k or taken[k - 1][1] <= a) and (k == len(taken) or b <= taken[k][0]):
            starts.insert(k, a)
            taken.insert(k, (a, b, word))
    out, at = [], 0
    for a, b, word in taken:
        out += [text[at:a], word]
        at = b
    return "".join([*out, text[at:]])


def expand(queries: DataFrame, glossary: DataFrame, query_key: str, text: str) -> DataFrame:
    """query_key, keyword_text, sentence.

    keyword_text: the query and all words of the groups it touches that it doesn't hold itself;
    sentence: the normalised query with each match replaced by its group's first word (longest
    match first), or the query itself without a match.  A null query stays null.

    The glossary goes to the executors as one automaton, by which each query is read once; a
    glossary above `GLOSSARY_BYTES` is refused, since its size comes from a file that people write.
    """
    words = glossary.select("group_no", "pos", "word", "norm")
    size = words.agg(F.coalesce(F.sum(F.octet_length("word") + F.octet_length("norm")), F.lit(0)).alias("n")).first().n
    if size > GLOSSARY_BYTES:
        raise ValueError(f"a glossary of {size} bytes")
    shared = queries.sparkSession.sparkContext.broadcast([tuple(r) for r in words.collect()])
    source = queries.select(F.col(query_key).alias("k"), F.col(text).alias("t"))
    schema = T.StructType([T.StructField(query_key, source.schema["k"].dataType), T.StructField("keyword_text", T.StringType()), T.StructField("sentence", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shared.value)
        for batch in batches:
            got = [(None, None) if t is None else automaton.expanded(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[i] for g in got], pa.string()) for i in (0, 1))], names=schema.names)

    return source.mapInArrow(run, schema)
