"""Very long urls, clashing columns, ids that are null or unknown."""

import pytest
from pyspark.sql import functions as F

from folioscope.llm import bpe, url_filter


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_long_urls_and_clashing_columns(spark, limit):
    long = "x" * 500_000
    urls = ["https://Bad.Example.com/" + long, "https://" + "a." * 2000 + "bad.example.com/p?q", "https://example.org/es/" + long, "https://" + long, long, None, "https://sub.bad.example.com"]
    listed = spark.createDataFrame([("bad.example.com",), (None,), ("bad.example.com",)], "key string")
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for c in ("host", "path", "rule", "verdict", "key", "__key", "__host", "__path"):
        df = df.withColumn(c, F.lit("clash"))
    out = url_filter.judge(df, url_filter.RULES, listed, limit=limit)
    assert out.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    got = {r.page_id: r for r in out.collect()}
    assert [got[i].verdict for i in range(7)] == ["block", "block", "block", "allow", "allow", "allow", "block"]
    assert (got[0].host, got[0].path) == ("bad.example.com", "/" + long) and got[2].rule == "example.org/es/"
    assert (got[3].host, got[3].path) == (long, "") and (got[4].host, got[5].path) == ("", "")


def test_decode_of_null_and_unknown_ids(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, [], "b"), (None, [5], "c")], "doc_id long, token_ids array<int>, text string")
    got = {r.doc_id: r.text for r in bpe.decode(df, bpe.vocabulary_path()).collect()}
    assert got[1] == got[2] == "" and len(got[None]) == 1
    with pytest.raises(Exception):
        bpe.decode(df.withColumn("token_ids", F.array(F.lit(10**8))), bpe.vocabulary_path()).collect()
