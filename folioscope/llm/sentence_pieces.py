"""SentencePiece (BPE) encoding and decoding with a public model, by a table of distinct chunks.

A text gets a marker in front and for each space.  No piece of such a model holds a marker after
another character, so no merge crosses from a word to the marker behind it: a text may be cut
in front of each run of markers, and equal chunks have equal ids wherever they stand.  A batch
of texts is cut in one pass over its bytes, Arrow finds the distinct chunks, only those that the
table doesn't hold are segmented, and the ids of all texts are gathered by position.  A model
whose pieces do cross markers (`Model.crosses`) is not cut: each text is one chunk.

Distinct chunks are merged by the segment trees of the BPE operator, many at a time.  The rank of
a pair is the place of its piece by falling score.  Where pieces of equal score could meet (only
runs of markers in the public model) or a chunk is long, an agenda by score and place takes over;
it needs n log n steps.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import NONE, ROW, merge_rows, vocabulary_path
from .codec import spread
from .words import pieces, text_buffer

MARK = "▁"
#: Chunks that are kept between batches; beyond it the table starts anew.
CACHE = 500_000
#: Symbols of characters that are no piece: this plus the code point.
LOOSE = 1 << 21
#: Kinds of pieces in a model file (fixed values).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: What the library writes for an unknown id unless the model says otherwise (fixed value).
UNKNOWN_TEXT = " ⁇ "


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    """Tables of a model file: pieces, the ranks of pairs, the bytes that each id stands for."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            message = list(_fields(f.read()))
        trainer = dict(_fields(next((v for k, v in message if k == 2), b"")))
        normal = dict(_fields(next((v for k, v in message if k == 3), b"")))
        if trainer.get(3) != 2 or normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError(f"{path}: only BPE models without a normaliser, with a marker in front, are read")
        self.strings, score, kinds = [], [], []
        for piece in (dict(_fields(v)) for k, v in message if k == 1):
            self.strings.append(piece[1].decode())
            score.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
            kinds.append(piece.get(3, NORMAL))
        if strange := set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path}: pieces of kind {sorted(strange)} are not read")
        self.kinds = np.array(kinds)
        byte_ids = np.flatnonzero(self.kinds == BYTE)
        self.byte_id = np.zeros(256, dtype=np.int64)
        self.byte_id[[int(self.strings[i][3:5], 16) for i in byte_ids]] = byte_ids
        if len(byte_ids) != 256:
            raise ValueError(f"{path}: only models with all bytes as pieces are read")
        ids = {s: i for i, s in enumerate(self.strings) if kinds[i] == NORMAL}
        self.crosses = any(MARK in s.lstrip(MARK) for s in ids)
        self.symbol = np.arange(0x110000, dtype=np.int64) + LOOSE
        for s, i in ids.items():
            if len(s) == 1:
                self.symbol[ord(s)] = i

        def symbol(s: str) -> int | None:
            return ids.get(s, LOOSE + ord(s) if len(s) == 1 else None)

        # a piece may come from any two parts; equal scores have equal ranks
        order = sorted({score[i] for i in ids.values()}, reverse=True)
        rank_of = {x: r for r, x in enumerate(order)}
        found = {}
        for s, i in ids.items():
            for cut in range(1, len(s)):
                a, b = symbol(s[:cut]), symbol(s[cut:])
                if a is not None and b is not None:
                    found[(a << 32) | b] = (rank_of[score[i]], i)
        self.pairs = np.array(sorted(found), dtype=np.int64)
        self.ranks = np.array([found[k][0] for k in self.pairs.tolist()], dtype=np.int64)
        self.table = found
        self.made = np.full(len(order), -1, dtype=np.int64)
        for s, i in ids.items():
            self.made[rank_of[score[i]]] = i
        often = Counter(score[i] for i in ids.values())
        tied = [s for s, i in ids.items() if often[score[i]] > 1 and len(s) > 1]
        least = [s for s in tied if not any(t != s and t in s for t in tied)]
        self.tied = re.compile("|".join(map(re.escape, least))) if least else None
        text = [b"" if k == CONTROL else UNKNOWN_TEXT.encode() if k == UNKNOWN else bytes([int(s[3:5], 16)]) if k == BYTE else s.replace(MARK, " ").encode() for s, k in zip(self.strings, kinds, strict=True)]
        self.bytes = pa.array(text, pa.large_binary())
        self.decimal = pa.array([str(i).encode() for i in range(len(text))], pa.large_binary())

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE if it doesn't merge."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NONE)

    def agenda(self, symbols: list[int]) -> list[int]:
        """Merges one chunk: the best score first, then the leftmost pair."""
        s, n = list(symbols), len(symbols)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (hit := self.table.get((s[i] << 32) | s[after[i]])):
                heapq.heappush(heap, (hit[0], i, s[i], s[after[i]], hit[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            if s[i] != a or after[i] >= n or s[after[i]] != b:
                continue  # one of the two has merged since
            gone = after[i]
            s[i], s[gone], after[i] = made, -1, after[gone]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [x for x in s if x >= 0]

    def segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks (with markers) in a row, and how many each has."""
        joined = "".join(chunks)
        base = self.symbol[np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)]
        size = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        start = np.cumsum(size) - size
        apart = size > ROW
        if self.tied is not None:
            apart |= np.fromiter((self.tied.search(c) is not None for c in chunks), dtype=bool, count=len(chunks))
        made, n, low = np.zeros(len(base), dtype=np.int64), np.zeros(len(chunks), dtype=np.int64), 0
        for width in (1, 4, 8, 16, 32, ROW):
            of = np.flatnonzero((size > low) & (size <= width) & ~apart)
            for part in np.array_split(of, max(1, len(of) * width // 400_000)):
                if len(part):
                    at = np.minimum(start[part][:, None] + np.arange(width)[None, :], len(base) - 1)
                    got, n[part] = merge_rows(self, base[at], size[part])
                    made[spread(start[part], n[part])] = got
            low = width
        for w in np.flatnonzero(apart).tolist():
            got = self.agenda(base[start[w] : start[w] + size[w]].tolist())
            n[w] = len(got)
            made[start[w] : start[w] + len(got)] = got
        return self._with_bytes(made[spread(start, n)], n)

    def _with_bytes(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece become the pieces of their bytes."""
        loose = np.flatnonzero(ids >= LOOSE)
        if not len(loose):
            return ids, n
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in (ids[loose] - LOOSE).tolist()]
        wide = np.ones(len(ids), dtype=np.int64)
        wide[loose] = list(map(len, raw))
        out = np.repeat(ids, wide)
        place = np.cumsum(wide) - wide
        out[spread(place[loose], wide[loose])] = self.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        total = np.concatenate([[0], np.cumsum(wide)])
        ends = np.cumsum(n)
        return out, total[ends] - total[ends - n]

    def joined(self, ids: np.ndarray, first: np.ndarray, values: pa.Array, separator: bytes) -> tuple[np.ndarray, memoryview]:
        """The values of each row's ids, joined: where each row's begin, and all their bytes."""
        rows = pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), values.take(pa.array(ids)))
        _, offsets, data = pc.binary_join(rows, pa.scalar(separator, pa.large_binary())).buffers()
        return np.frombuffer(offsets, dtype=np.int64)[: len(first)], memoryview(data) if data is not None else memoryview(b"")

    def decode(self, ids: list[int]) -> str:
        """The text of any ids, as the library decodes them; an unknown id fails."""
        out, run, front, seen = [], bytearray(), True, False

        def flush() -> None:
            at = 0
            while at < len(run):
                for width in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + width]).decode("utf-8"))
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    width = 1
                at += width
            run.clear()

        for i in ids:
            if not 0 <= i < len(self.strings):
                raise ValueError(f"id {i} is not in the model")
            kind, s = self.kinds[i], self.strings[i]
            if kind == BYTE:
                run.append(int(s[3:5], 16))
                continue
            flush()
            if seen or any(out):
                front = False
            seen = False
            if kind == NORMAL:
                seen = front and s.startswith(MARK)
                out.append(s[seen:].replace(MARK, " "))
            elif kind == UNKNOWN:
                out.append(UNKNOWN_TEXT)
        flush()
        return "".join(out)

    def texts(self, ids: np.ndarray, first: np.ndarray) -> list[bytes | memoryview]:
        """The decoded text of each row of ids, in UTF-8."""
        at, raw = self.joined(ids, first, self.bytes, b"")
        plain = np.ones(len(self.kinds) + 1, dtype=bool)
        plain[:-1] = (self.kinds == NORMAL) | (self.kinds == BYTE)
        odd = np.concatenate([[0], np.cumsum(~plain[ids])])
        out, begins, at = [], first.tolist(), at.tolist()
        for r in range(len(first) - 1):
            part = raw[at[r] : at[r + 1]]
            if begins[r] < begins[r + 1] and self.strings[ids[begins[r]]].startswith(MARK):
                part = part[1:]
            whole = odd[begins[r]] == odd[begins[r + 1]]
            if whole:
                try:
                    str(part, "utf-8")
                except UnicodeDecodeError:
                    whole = False
            out.append(part if whole else self.decode(ids[begins[r] : begins[r + 1]].tolist()).encode())
        return out


def cut_texts(column: pa.Array, whole: bool) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts (a space for each marker), and where each text's begin.

    A text of at least one character gets a marker in front.  A chunk begins where a marker
    follows another character.  With `whole` each text is one chunk.
    """
    column = pc.replace_substring(column.fill_null("").cast(pa.large_string()), MARK, " ")
    column = pc.if_else(pc.equal(pc.binary_length(column), 0), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
    data, offsets = text_buffer(column)
    cuts = np.zeros(len(data), dtype=bool)
    if not whole and len(data):
        space = data == 0x20
        cuts[1:] = space[1:] & ~space[:-1]
    begins = offsets[:-1][offsets[1:] > offsets[:-1]]
    cuts[begins] = True
    starts = np.flatnonzero(cuts)
    edges = np.append(starts, len(data)).astype(np.int64)
    chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data)))
    return chunks, np.searchsorted(starts, offsets, side="left")


class Encoder:
    """Encodes texts; keeps the ids of the distinct chunks that it has met, in one array."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._start()

    def _start(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        ids, size = self.model.segment([c.replace(" ", MARK) for c in new])
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size])

    def batch(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one more than texts)."""
        chunks, per_text = cut_texts(column, self.model.crosses)
        coded = chunks.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [c for c in distinct if c not in self.place]
        if len(self.place) + len(new) > CACHE and self.place:
            self._start()
            new = distinct
        if new:
            self._learn(new)
        known = np.fromiter(map(self.place.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        at = known[np.asarray(coded.indices, dtype=np.int64)] if len(distinct) else np.zeros(0, np.int64)
        size = self.size[at]
        ids = self.ids[spread(self.first[at], size)]
        return ids, np.concatenate([[0], np.cumsum(size)])[per_text]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: bool = True, digests: bool = True) -> DataFrame:
    """key, n_tokens, and as wanted token_ids, or ids_sha256 and decoded_sha256 of the round trip.

    One row for each row of docs; an empty table gives none.  A null text is an empty one and has
    no tokens; null and repeated keys and repeated rows are kept, other columns are ignored,
    whatever their names.  A text of any length is encoded whole, also one without spaces; equal
    scores go by place, as in the library.
    """
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(Model(path))
    fields = [T.StructField(key, source.schema["k"].dataType), T.StructField("n_tokens", T.LongType())]
    if ids:
        fields.append(T.StructField("token_ids", T.ArrayType(T.IntegerType())))
    if digests:
        fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        encoder = Encoder(model)
        for piece in pieces(batches, "t", 1 << 20):
            got, first = encoder.batch(piece.column(1))
            columns = [piece.column(0), pa.array(np.diff(first), pa.int64())]
            if ids:
                columns.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(got, pa.int32())))
            if digests:
                at, raw = model.joined(got, first, model.decimal, b",")
                columns.append(pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string()))
                columns.append(pa.array([hashlib.sha256(t).hexdigest() for t in model.texts(got, first)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """key, text: the decoded text of each row; null ids are empty, bytes that are no UTF-8 become U+FFFD.

    Rows are kept as they are, repeated ones too; an empty table gives none.  An unknown id fails.
    """
    source = encoded.select(F.col(key).alias("k"), F.col(ids).alias("t"))
    shared = encoded.sparkSession.sparkContext.broadcast(Model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return source.mapInArrow(run, T.StructType([T.StructField(key, source.schema["k"].dataType), T.StructField("text", T.StringType())]))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path("piece_bpe_32k.model"), ids=False)


QUERIES = {"op13_sentencepiece": op13_sentencepiece}
