"""Input columns named like those that operators use or return, and very long texts."""

from collections import Counter

from pyspark.sql import functions as F

from folioscope.llm import decontamination, jaccard_join, lm_scoring, pii

NAMES = ["__id", "__t", "__row", "__h", "__hit", "__gone", "__twice", "__e", "__bad", "rid", "k", "n", "node", "root", "old", "value", "kind", "n_words", "log_score", "n_shingles", "component_id", "n_entities"]
LONG = " ".join(f"w{i % 977}" for i in range(120_000))
ROWS = [(1, "one two three four five six seven"), (2, "one two three four five six seven"), (3, LONG), (4, LONG + " end"), (5, None), (None, "Mr John Smith, one two"), (6, "John Smith " * 3), (6, "q r s t u v w x y z a b c d")]


def tables(spark):
    bare = spark.createDataFrame(ROWS, "doc_id long, text string")
    return bare, bare.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in NAMES])


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_results_do_not_depend_on_other_columns(spark):
    bare, wide = tables(spark)
    for op in (lm_scoring.score, jaccard_join.join):
        assert op(wide).columns == op(bare).columns and rows(op(wide)) == rows(op(bare))
    n = {r.doc_id: r.n_words for r in lm_scoring.score(wide).collect()}
    assert n[3] == 120_000 and n[5] == 0
    component = {r.doc_id: r.component_id for r in jaccard_join.join(wide).where("doc_id < 6").collect()}
    assert component == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_stages_keep_other_columns(spark):
    bare, wide = tables(spark)
    bench = spark.createDataFrame([("b", "q r s t u v w x y z a b c")], "item_id string, text string")
    stages = [lambda d: jaccard_join.one_of_each(d), lambda d: decontamination.drop_contaminated(d, bench), lambda d: decontamination.drop_contaminated(d, bench, limit=-1), lambda d: pii.replace(d, report=False)]
    for stage in stages:
        out = stage(wide)
        assert out.columns == wide.columns and rows(out.select("doc_id", "text")) == rows(stage(bare))
        for r in out.collect():
            assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for c in NAMES)
    assert pii.replace(wide).columns == [c for c in wide.columns if c != "n_entities"] + ["n_entities", "entity_kinds"]
