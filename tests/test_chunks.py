"""Chunks by a measure that doesn't add up, a model's sections in rounds, titles."""

import json
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from folioscope.operators import chunking as ck

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests


def odd_measure(text):
    """Pairs of letters count once where they meet, so parts don't add up."""
    return len(text) - text.count("ab") + 3 * text.count("zz")


def test_reach_finds_the_farthest():
    r = random.Random(2)
    for _ in range(500):
        start, end = (a := r.randint(0, 20)), a + r.randint(1, 60)
        far = r.randint(start + 1, end)
        calls = []
        assert ck.reach(start, end, lambda k: calls.append(k) or k <= far) == far
        assert len(calls) <= 2 * (end - start).bit_length() + 2


def one_by_one(o, lo, hi, limit):
    """The same cuts, each part packed by trying every next one."""
    if o.measure(o.shown(lo, hi)) <= limit:
        return [(lo, hi)]
    for worst in sorted({a.cost for a in o.atoms[lo + 1 : hi]}):
        cut = o.parts(lo, hi, worst)
        if len(cut) > 1:
            packed = [cut[0]]
            for a, b in cut[1:]:
                if o.measure(o.shown(packed[-1][0], b)) <= limit:
                    packed[-1] = (packed[-1][0], b)
                else:
                    packed.append((a, b))
            return [p for a, b in packed for p in one_by_one(o, a, b, limit)]
    return [(lo, hi)]


def random_text(r):
    rows = []
    for _ in range(r.randint(1, 30)):
        kind = r.random()
        words = " ".join("".join(r.choices("abz", k=r.randint(1, 6))) + r.choice(["", ".", "!"]) for _ in range(r.randint(1, 12)))
        if kind < 0.15:
            rows.append("#" * r.randint(1, 4) + " " + words)
        elif kind < 0.25:
            rows += ["```", *(words[i::3] + "x" for i in range(3)), "```"]
        else:
            rows.append(words)
        if r.random() < 0.4:
            rows.append("")
    return "\n".join(rows)


def test_sizes_that_do_not_add_up():
    r = random.Random(6)
    for _ in range(300):
        text, limit = random_text(r), r.randint(5, 80)
        o = ck.Outline(text, len, additive=False)
        assert o.fitted(0, len(o.atoms), limit) == one_by_one(o, 0, len(o.atoms), limit)
        odd = ck.Outline(text, odd_measure, additive=False)
        spans = odd.fitted(0, len(odd.atoms), limit)
        assert [a for a, _ in spans] == [0, *(b for _, b in spans[:-1])] and spans[-1][1] == len(odd.atoms)
        for a, b in spans:  # above the limit only where nothing can be cut
            assert odd.size(a, b) <= limit or all(len(odd.parts(a, b, worst)) < 2 for worst in range(9))


def test_code_pieces_are_measured_with_their_fences():
    text = "```py\n" + "\n".join(f"a{i} = {i}" for i in range(50)) + "\n```"
    made = ck.chunks_of(text, 60, measure=len, additive=False)
    assert len(made) > 5 and all(len(c["text"]) <= 60 and c["text"].startswith("```py\n") and c["text"].endswith("\n```") for c in made)
    assert "".join(c["text"][6:-3] for c in made) == text[6:-3]


def test_token_chunks_stay_below_the_limit(spark):
    from folioscope import plans
    from folioscope.plans.scalars import token_counter
    from public_tokenizers import path

    count = token_counter(path("byte_bpe_50k.json"))
    rows = plans.queries()["c06_token_chunks"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    kept = {}
    for r in rows:
        kept.setdefault(r.doc_id, []).append(r)
        if count(r.text) > 128:
            o = ck.Outline(r.text)
            assert all(len(o.parts(0, len(o.atoms), worst)) < 2 for worst in range(9)), r.text
    squeeze = lambda s: "".join(s.split())
    assert {k: squeeze("".join(r.text for r in sorted(v, key=lambda r: int(r.chunk_key[5:])))) for k, v in kept.items()} == {k: squeeze(t) for k, t in texts.items() if t and t.strip()}


def answers(asked):
    """A model that does well at once, after a fault, never, or by its faults; notes what it is asked."""
    good = lambda t: json.dumps({"chunks": [{"start_line": 1, "end_line": 1, "title": "one", "summary": "s"}, {"start_line": 2, "end_line": len(t.split("\n")), "title": "two", "summary": "s"}]})

    def model(texts, faults):
        out = []
        for t, fault in zip(texts, faults, strict=True):
            with open(asked, "a") as f:
                f.write(json.dumps([t.split("\n")[0], fault]) + "\n")
            name = t.split("\n")[0]
            if name == "never":
                out.append("no json")
            elif name == "second" and fault is None:
                out.append(json.dumps({"chunks": [{"start_line": 1, "end_line": 1, "title": "one", "summary": "s"}]}))
            elif name == "third" and fault != "empty_title":
                out.append(None if fault is None else json.dumps({"chunks": [{"start_line": 1, "end_line": 1, "title": "", "summary": "s"}]}))
            else:
                out.append(good(t))
        return out

    return model


def test_model_rounds(spark, tmp_path):
    asked = str(tmp_path / "asked")
    docs = spark.createDataFrame([(i, None if n is None else f"{n}\nbody of it.\n# not cut here\nend" if n else " ") for i, n in enumerate(["first", "second", "third", "never", "", None])], "doc_id int, text string").repartition(2)
    got = ck.model_sections_of(docs, "doc_id", "text", lambda: answers(asked))
    rows = {r.doc_id: (r.asked, r.fault, r.sections and len(r.sections)) for r in got.collect()}
    assert rows == {0: (1, None, 2), 1: (2, None, 2), 2: (3, None, 2), 3: (3, "not_json", None), 4: (0, None, None), 5: (0, None, None)}
    got.count()
    calls = [tuple(json.loads(x)) for x in open(asked)]
    assert sorted(calls, key=str) == sorted([("first", None), ("second", None), ("second", "uncovered"), ("third", None), ("third", "not_json"), ("third", "empty_title"), ("never", None), ("never", "not_json"), ("never", "not_json")], key=str)
    made = ck.chunk(got, "doc_id", "text", sections="sections")
    titles = {}
    for r in made.orderBy("doc_id", "order").collect():
        titles.setdefault(r.doc_id, []).append(r.title)
    assert titles == {0: ["one", "two"], 1: ["one", "two"], 2: ["one", "two"], 3: [None, None]}

    def load():
        return lambda heads, texts, faults: [json.dumps({"title": f"T {h}|{t[:5]}", "summary": "S" if f else " "}) if "end" in t else "{" for h, t, f in zip(heads, texts, faults, strict=True)]

    filled = {(r.doc_id, r.order): (r.title, r.summary) for r in ck.titled(made, load).collect()}
    assert filled[3, 1] == ("T not cut here|# not", "S") and filled[3, 0] == (None, None) and filled[0, 0] == ("one", "s") and len(filled) == 8


def test_model_answers_of_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id int, text string")
    assert ck.model_sections_of(docs, "doc_id", "text", lambda: answers(str(tmp_path / "x"))).count() == 0
    assert ck.chunk(docs, "doc_id", "text", load_measure=lambda: len).count() == 0


def test_faulty_models_fail_loudly(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    with pytest.raises(Exception, match="results for"):
        ck.model_sections_of(docs, "doc_id", "text", lambda: lambda t, f: []).select(F.col("asked")).collect()


def test_batches_go_in_pieces_of_bounded_bytes(monkeypatch):
    import pyarrow as pa

    from folioscope.functions import batches
    from folioscope.operators import assets, chunking

    monkeypatch.setattr(batches, "PIECE_BYTES", 10)
    texts = ["a" * 4, None, "b" * 6, "c", "d" * 30, "", "e" * 3]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts, pa.string())], names=["k", "t"])
    got = [x.column(1).to_pylist() for x in batches.pieces(iter([batch, batch.slice(0, 0), batch.slice(5)]), 1)]
    assert got == [texts[:3], texts[3:4], texts[4:5], texts[5:], texts[5:]]
    # both makers of Python objects take their rows so
    assert assets.pieces is batches.pieces and chunking.pieces is batches.pieces


def test_remembered_words_have_the_tokens_of_whole_texts(monkeypatch):
    from folioscope.plans import scalars
    from public_tokenizers import path
    from tokenizers import Tokenizer

    file = path("byte_bpe_50k.json")
    plain, encoded = Tokenizer.from_file(file), []
    monkeypatch.setattr(scalars, "KNOWN_WORDS", 300)
    count, r = scalars.token_counter(file), random.Random(5)
    signs = ["a", "Zo", "'s", "'ll", "'", "'S", " ", "  ", "\n", "\n\n", "\t", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "​", "　", "1", "²", "½", "٣", "é", "é", "ß", "ſ", "ʼs", "漢", "가", "😀", "_", "-", "...", "\x00", "\x7f", "Ⅷ", "\U0001e900", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(r.choices(signs[: r.choice([20, len(signs)])], k=r.randint(0, 25)))
        assert count(text) == len(plain.encode(text, add_special_tokens=False).ids), repr(text)
    texts = [chr(i) + "a" + chr(i) + " " + chr(i) + "1" for i in range(0x3000) if not 0xD800 <= i < 0xE000]
    assert [count(t) for t in texts] == [len(plain.encode(t, add_special_tokens=False).ids) for t in texts]

    # a text of known words isn't encoded again
    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def __getattr__(self, name):
            return getattr(self.tokenizer, name)

        def encode(self, text, **kw):
            encoded.append(text)
            return self.tokenizer.encode(text, **kw)

    monkeypatch.setattr("tokenizers.Tokenizer", type("T", (), {"from_file": staticmethod(lambda p: Counting(plain))}))
    again = scalars.token_counter(file)
    again("some words and some words")
    first = len(encoded)
    again(" some words and some")
    assert len(encoded) == first == 4
