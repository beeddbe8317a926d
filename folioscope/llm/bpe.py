"""BPE encoding and decoding with a public vocabulary (BPE with word ends).

A text is normalised and split into words; the bytes of a word are its first symbols, the last
one marked as word end.  A segment tree holds the merge ranks of adjacent pairs.  Its root
yields the leftmost pair of the lowest rank; a merge changes three leaves and their paths to
the root.  Words end when the root is empty.  Words of up to 64 symbols are merged many at a
time, one tree per row of an array; longer ones have a tree of their own, so a word of any
length takes n log n steps.

Each distinct word is encoded once for as long as a bounded table keeps it, which holds the ids
of words in one array; texts are then gathers from it, and Arrow joins the strings of ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .codec import spread
from .words import pieces

NONE = np.int64(1) << np.int64(62)
#: Words that are kept between batches; beyond it, those that were used least go.
CACHE = 500_000
#: What marks the uses of a word that the batch at hand needs.
NOW = 1 << 40
#: Symbols of the longest words that are merged many at a time.
ROW = 64
#: What \s stands for (fixed values, Unicode White_Space).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _ranges(major: str, top: int) -> str:
    out, start = [], None
    for c in range(top + 2):
        inside = c <= top and unicodedata.category(chr(c))[0] == major
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def _splitter(top: int) -> re.Pattern:
    letters, numbers = _ranges("L", top), _ranges("N", top)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{SPACE}{letters}{numbers}]+")


class Splitter:
    """Words of a text: the vocabulary's normaliser and pre-tokeniser."""

    def __init__(self) -> None:
        self.ascii, self.bmp, self.all = _splitter(0x7F), _splitter(0xFFFF), None
        self.astral = re.compile("[\U00010000-\U0010ffff]")

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii.findall(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower() makes a final sigma at a word's end, the normaliser does not
            text = text.replace("Σ", "σ")
        text = text.lower()
        if self.astral.search(text):
            self.all = self.all or _splitter(0x10FFFF)
            return self.all.findall(text)
        return self.bmp.findall(text)


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte, as byte-level vocabularies have it."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    sign = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [sign[b] for b in range(256)]


class Vocabulary:
    """Tables of a tokenizer file: first symbols, merges, and the string of each id."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {v: k for k, v in ids.items()} | {v: k for k, v in self.special.items()}
        signs = _byte_symbols()
        self.inner = np.array([ids[s] for s in signs], dtype=np.int64)
        self.last = np.array([ids[s + end] for s in signs], dtype=np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = np.array([(ids[a] << 32) | ids[b] for a, b in merges], dtype=np.int64)
        made = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(pairs, kind="stable")
        first = np.ones(len(order), dtype=bool)
        first[1:] = pairs[order][1:] != pairs[order][:-1]
        self.pairs, self.ranks, self.made = pairs[order][first], order[first], made

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE if it doesn't merge."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NONE)

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder: the strings of the ids, joined by spaces."""
        return " ".join(map(self.strings.__getitem__, ids))


def merge_rows(v: Vocabulary, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merges the words in the rows of symbols (of length 1 to ROW), each with a tree of its own.

    The ids of all words in a row, and how many each has.
    """
    n, leaves = len(symbols), 1
    while leaves < symbols.shape[1]:
        leaves *= 2
    s = np.zeros((n, leaves + 1), dtype=np.int64)
    s[:, : symbols.shape[1]] = symbols
    cols = np.arange(leaves)
    after = np.broadcast_to(np.arange(1, leaves + 2), (n, leaves + 1)).copy()
    before = np.broadcast_to(np.arange(-1, leaves), (n, leaves + 1)).copy()
    live = np.arange(leaves + 1)[None, :] < length[:, None]
    tree = np.full((n, 2 * leaves), NONE)
    has = cols[None, :] < (length - 1)[:, None]
    r = np.full((n, leaves), NONE)
    r[has] = v.rank(s[:, :-1][has], s[:, 1:][has])
    tree[:, leaves:] = np.where(r < NONE, (r << 8) | cols[None, :], NONE)
    for k in range(leaves - 1, 0, -1):
        tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])

    def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + leaves
        tree[rows, node] = value
        while node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        top = tree[rows, 1]
        i = top & 255
        j = after[rows, i]
        k = after[rows, j]
        s[rows, i] = v.made[top >> 8]
        live[rows, j] = False
        after[rows, i] = k
        before[rows, np.minimum(k, leaves)] = i
        put(rows, j, NONE)
        right = k < length[rows]
        rank = np.full(len(rows), NONE)
        rank[right] = v.rank(s[rows[right], i[right]], s[rows[right], k[right]])
        put(rows, i, np.where(rank < NONE, (rank << 8) | i, NONE))
        p = before[rows, i]
        left = np.flatnonzero(p >= 0)
        if len(left):
            lr, lp = rows[left], p[left]
            rank = v.rank(s[lr, lp], s[lr, i[left]])
            put(lr, lp, np.where(rank < NONE, (rank << 8) | lp, NONE))
        rows = rows[tree[rows, 1] < NONE]
    return s[live], live.sum(axis=1)


def merge_one(v: Vocabulary, symbols: list[int]) -> list[int]:
    """Merges one word of any length."""
    n, leaves = len(symbols), 1
    while leaves < n:
        leaves *= 2
    none = (1 << 62, 0)
    table = dict(zip(v.pairs.tolist(), v.ranks.tolist(), strict=True)) if not hasattr(v, "table") else v.table
    v.table = table
    s = list(symbols)
    after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    tree = [none] * (2 * leaves)

    def leaf(i: int, j: int) -> tuple[int, int]:
        rank = table.get((s[i] << 32) | s[j]) if j < n else None
        return none if rank is None else (rank, i)

    for i in range(n - 1):
        tree[leaves + i] = leaf(i, i + 1)
    for k in range(leaves - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: tuple[int, int]) -> None:
        node = leaves + i
        tree[node] = value
        while node > 1:
            node >>= 1
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

    while tree[1] != none:
        rank, i = tree[1]
        j = after[i]
        k = after[j]
        s[i], live[j], after[i] = int(v.made[rank]), False, k
        if k < n:
            before[k] = i
        put(j, none)
        put(i, leaf(i, k))
        if before[i] >= 0:
            put(before[i], leaf(before[i], i))
    return [x for x, alive in zip(s, live, strict=True) if alive]


def encode_words(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in a row, and how many each has."""
    raw = [w.encode("utf-8") for w in words]
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    start = np.cumsum(size) - size
    base = v.inner[data]
    base[start + size - 1] = v.last[data[start + size - 1]]
    # a word has no more ids than bytes: each is merged in its own place, then the gaps go
    made, n = np.zeros(len(base), dtype=np.int32), np.zeros(len(words), dtype=np.int64)
    low = 0
    for width in (1, 4, 8, 16, 32, ROW):
        of = np.flatnonzero((size > low) & (size <= width))
        for part in np.array_split(of, max(1, len(of) * width // 400_000)):
            if len(part):
                at = np.minimum(start[part][:, None] + np.arange(width)[None, :], len(base) - 1)
                got, n[part] = merge_rows(v, base[at], size[part])
                made[spread(start[part], n[part])] = got
        low = width
    for w in np.flatnonzero(size > ROW).tolist():
        got = merge_one(v, base[start[w] : start[w] + size[w]].tolist())
        n[w] = len(got)
        made[start[w] : start[w] + len(got)] = got
    return made[spread(start, n)], n


class Encoder:
    """Encodes texts; keeps the ids of words that it has met, in one array."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, self.split = v, Splitter()
        self.marks = re.compile("(" + "|".join(map(re.escape, v.special)) + ")") if v.special else None
        self._start()

    def _start(self) -> None:
        # special tokens come first; no other word begins with a space
        self.place: dict[str, int] = {f" {mark}": i for i, mark in enumerate(self.v.special)}
        self.ids = np.array(list(self.v.special.values()), dtype=np.int32)
        self.first, self.size = np.arange(len(self.ids)), np.ones(len(self.ids), dtype=np.int64)
        self.uses = np.ones(len(self.ids), dtype=np.int64)

    def _keep(self, words: dict[str, int], of: np.ndarray) -> None:
        """Goes on with these words, which stand at `of` now."""
        self.place = words
        self.ids = self.ids[spread(self.first[of], self.size[of])]
        self.size, self.uses = self.size[of], self.uses[of] // 2
        self.first = np.cumsum(self.size) - self.size

    def _learn(self, new: list[str]) -> None:
        if len(self.place) + len(new) > CACHE:  # what was used most stays
            names, marks = list(self.place), len(self.v.special)
            least = max(CACHE // 2, int((self.uses >= NOW).sum()))
            rank = np.argsort(-self.uses[marks:], kind="stable")[:least]
            of = np.concatenate([np.arange(marks), marks + np.sort(rank)])
            self._keep({names[i]: k for k, i in enumerate(of.tolist())}, of)
        ids, size = encode_words(self.v, new)
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), dtype=np.int64)])

    def _words(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.marks and "<|" in text and len(parts := self.marks.split(text)) > 1:
            return [w for p, part in enumerate(parts) for w in ([f" {part}"] if p % 2 else self.split.words(part))]
        return self.split.words(text)

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one more than texts)."""
        split = [self._words(t) for t in texts]
        words = [w for ws in split for w in ws]
        if new := list(set(words).difference(self.place)):
            if len(self.place) + len(new) > CACHE:
                # words of this batch must not go while it is encoded
                self.uses[[self.place[w] for w in set(words).intersection(self.place)]] += NOW
                self._learn(new)
                self.uses %= NOW // 2
            else:
                self._learn(new)
        at = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))
        np.add.at(self.uses, at, 1)
        size = self.size[at]
        ids = self.ids[spread(self.first[at], size)]
        per_word = np.concatenate([[0], np.cumsum(size)])
        return ids, per_word[np.cumsum([0, *map(len, split)])]


class Writer:
    """The strings of ids in Arrow, to join many rows of them at once."""

    def __init__(self, v: Vocabulary) -> None:
        top = max(v.strings) + 1
        self.decimal = pa.array(map(str, range(top)), pa.large_string())
        self.string = pa.array([v.strings.get(i) for i in range(top)], pa.large_string())

    def digests(self, strings: pa.Array, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """SHA-256 of each row's strings, joined by spaces."""
        rows = pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), strings.take(pa.array(ids)))
        _, offsets, data = pc.binary_join(rows, pa.scalar(" ", pa.large_string())).buffers()
        at, raw = np.frombuffer(offsets, dtype=np.int64).tolist(), memoryview(data) if data is not None else b""
        return [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[: len(first) - 1], at[1 : len(first)], strict=True)]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: bool = True, digests: bool = True) -> DataFrame:
    """key, n_tokens, and as wanted token_ids, or ids_sha256 and decoded_sha256 of the round trip.

    One row for each row of docs; an empty table gives none.  A null text is an empty one and has
    no tokens; null and repeated keys and repeated rows are kept, other columns are ignored,
    whatever their names.  A text of any length is encoded whole.
    """
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    fields = [T.StructField(key, source.schema["k"].dataType), T.StructField("n_tokens", T.LongType())]
    if ids:
        fields.append(T.StructField("token_ids", T.ArrayType(T.IntegerType())))
    if digests:
        fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = Encoder(shared.value), Writer(shared.value)
        for piece in pieces(batches, "t", 1 << 20):
            got, first = encoder.batch(piece.column(1).to_pylist())
            columns = [piece.column(0), pa.array(np.diff(first), pa.int64())]
            if ids:
                columns.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(got)))
            if digests:
                columns += [pa.array(writer.digests(s, got, first), pa.string()) for s in (writer.decimal, writer.string)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """key, text: the decoded text of each row; null ids are empty.  An unknown id fails."""
    source = encoded.select(F.col(key).alias("k"), F.col(ids).alias("t"))
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return source.mapInArrow(run, T.StructType([T.StructField(key, source.schema["k"].dataType), T.StructField("text", T.StringType())]))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path(), ids=False)


QUERIES = {"op2_bpe": op2_bpe}
