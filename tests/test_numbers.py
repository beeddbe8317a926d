"""Term frequencies by number: counted in pieces, whatever the splits of the input."""

from collections import Counter
from hashlib import blake2b

import pyarrow as pa
import pytest

from folioscope import plans
from folioscope.functions import batches
from folioscope.operators import retrieval as rt

number = lambda t: int.from_bytes(blake2b(t.encode(), digest_size=4).digest(), "big")


def sharing() -> tuple[str, str]:
    """Two words of one number."""
    seen = {}
    for w in (f"w{i}" for i in range(10**6)):
        if (other := seen.setdefault(number(w), w)) != w:
            return other, w
    raise AssertionError


def counted(rows):
    out = Counter()
    for k, text in rows:
        out.update((k, number(t)) for t in (text or "").lower().split())
    return out


def result(df):
    found = [((r[0], r.number), r.tf) for r in df.collect()]
    assert len({k for k, _ in found}) == len(found)
    return dict(found)


@pytest.mark.parametrize(("kind", "key"), [("int", int), ("string", str)])
def test_numbered_postings(spark, kind, key):
    a, b = sharing()
    texts = [(1, f"{a} {b} x X"), (1, f"{a} y"), (2, None), (2, ""), (2, "..."), (2, "x"), (None, "x y"), (None, "x"), (3, "인증"), (4, " ".join(f"t{i}" for i in range(300)))]
    texts = [(k if k is None else key(k), t) for k, t in texts]
    want = counted([(k, t) for k, t in texts if t not in ("...", "인증")] + [(key(3), "인증")])
    for parts in (None, 1, 5):
        df = rt.numbered_postings(spark.createDataFrame(texts, f"k {kind}, t string").repartition(4), "k", "t", parts)
        assert result(df) == want and df.dtypes == [("k", kind), ("number", "bigint"), ("tf", "bigint")]
    assert rt.numbered_postings(spark.createDataFrame([], f"k {kind}, t string"), "k", "t").count() == 0


def test_a_key_over_several_batches(spark):
    """Rows of a key in other Arrow batches are counted together; nothing is grouped by term."""
    texts = [(i // 7, f"a w{i % 3} w{i % 3} b{i}") for i in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        df = rt.numbered_postings(spark.createDataFrame(texts, "k int, t string"), "k", "t", 2)
        assert result(df) == counted(texts)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


def test_pieces_of_words(monkeypatch):
    monkeypatch.setattr(batches, "PIECE_WORDS", 3)
    lists = [["a"], None, ["b", "c"], [], ["d"] * 5, ["e"], ["f", "g"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(lists, pa.list_(pa.string()))], names=["k", "w"])
    assert [p.column(0).to_pylist() for p in batches.word_pieces(iter([batch]), 1)] == [[0, 1, 2, 3], [4], [5, 6]]


def test_query_over_many_files(spark, tmp_path):
    """As many splits as cores; this input stopped with an internal error."""
    texts = [(i, f"one two two w{i}") for i in range(64)]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(16).write.option("maxRecordsPerFile", 1).parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert result(plans.queries()["k04_term_numbers"](spark, str(tmp_path))) == counted(texts)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
