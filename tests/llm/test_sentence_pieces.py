"""SentencePiece encoding against the library: random texts, awkward texts, whole tables, decoding of any ids."""

import hashlib
import os
import random

import pyarrow as pa
import pytest
import sentencepiece

from folioscope.llm import sentence_pieces
from folioscope.llm.bpe import vocabulary_path

PATH = vocabulary_path("piece_bpe_32k.model")
DIR = "/root/testdata/sf0.001"
AWKWARD = [
    "", " ", "  ", "   a", "a  b ", "\n", "a\nb\r\n\tc", "▁x", "a▁▁b", "\x00a", "é😀", "﷽", "ＡＢ", "<s>hi</s>", "<unk><0x41>", " x",
    "é", "​", "x" * 5000, "ab" * 3000, " " * 1000, "日本語の文章です。" * 50, "\U0001f468‍\U0001f469‍\U0001f467", "don't  stop",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return sentence_pieces.Model(PATH)


def test_ids_and_texts_equal_the_library(library, model):
    r = random.Random(5)
    parts = ["the", "tion", "ing", " ", "  ", "   ", "▁", "é", "ß", "語", "😀", "\n", "\t", ".", "Q", "z", "zz", "12", "﷽", "́"]
    texts = AWKWARD + [" " * n for n in range(1, 80)] + [" " * n + "the" for n in range(1, 40)]
    texts += ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    encoder = sentence_pieces.Encoder(model)
    ids, first = encoder.batch(pa.array([*texts, None]))
    got = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [*library.encode(texts), []]
    assert [bytes(t).decode() for t in model.texts(ids, first)] == [*(library.decode(x) for x in got[:-1]), ""]


def test_decode_of_any_ids(library, model):
    r = random.Random(7)
    special = [0, 1, 2, *range(3, 259), 259, 260, 28705]
    for _ in range(2000):
        ids = [r.choice(special) if r.random() < 0.6 else r.randrange(32000) for _ in range(r.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids), ids
    with pytest.raises(ValueError, match="not in the model"):
        model.decode([32000])


def test_the_table_starts_anew(model, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "CACHE", 5)
    small, large = sentence_pieces.Encoder(model), sentence_pieces.Encoder(model)
    for text in ("one two three", "four five six seven eight nine ten", "one two", "one"):
        a, b = small.batch(pa.array([text])), large.batch(pa.array([text]))
        assert a[0].tolist() == b[0].tolist()


def test_models_whose_pieces_cross_markers_are_not_cut():
    chunks, first = sentence_pieces.cut_texts(pa.array(["a b  c", "", None, " d"]), False)
    assert chunks.to_pylist() == [" a", " b", "  c", "  d"] and first.tolist() == [0, 3, 3, 3, 4]
    chunks, first = sentence_pieces.cut_texts(pa.array(["a b  c", "", None, " d"]), True)
    assert chunks.to_pylist() == [" a b  c", "  d"] and first.tolist() == [0, 1, 1, 1, 2]
    assert not len(sentence_pieces.cut_texts(pa.array([], pa.string()), False)[0])


def test_operator_on_awkward_tables(spark, library):
    rows = [(i, t, 1, "x") for i, t in enumerate([*AWKWARD, None])] + [(0, "again", 1, "x"), (None, "again", 1, "x"), (None, "again", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, t string").repartition(3)
    out = sentence_pieces.encode(docs, PATH)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, list(r.token_ids), r.ids_sha256, r.decoded_sha256) for r in out.collect())

    def want(k, t):
        ids = library.encode(t or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return (k is None, k or 0, len(ids), ids, sha(",".join(map(str, ids))), sha(library.decode(ids)))

    assert got == sorted(want(r[0], r[1]) for r in rows)
    back = {(r.doc_id, r.text) for r in sentence_pieces.decode(out, PATH).collect()}
    assert back == {(r[0], library.decode(library.encode(r[1] or ""))) for r in rows}
    assert sentence_pieces.encode(docs.limit(0), PATH).count() == 0
    nulls = spark.createDataFrame([(1, None)], "doc_id long, token_ids array<int>")
    assert sentence_pieces.decode(nulls, PATH).collect()[0].text == ""


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_query_over_the_whole_table(spark, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sentence_pieces.op13_sentencepiece(spark, DIR).collect()}
    want = {}
    for r in spark.read.parquet(f"{DIR}/documents.parquet").collect():
        ids = library.encode(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert got == want
