"""The pipeline and each of its stages on a small corpus, against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import bpe, decontamination, pii, toxicity

from test_llm import LETTER, SPACED, split

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    r = random.Random(31)
    vocab = [f"word{i}" for i in range(300)]
    bad = ["scum", "vile", "filth", "hate"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    out = []
    for i in range(160):
        w = text(r.randint(30, 90)).split()
        if i % 8 == 0:
            for _ in range(len(w) // 3):
                w[r.randrange(len(w))] = r.choice(bad)
        out.append((i, " ".join(w)))
    plain = [t for i, t in out if i % 8]
    out += [(1000 + k, plain[k]) for k in range(5)]  # copies
    out += [(1100 + k, plain[k] + " tail") for k in range(5, 9)]  # near copies
    out += [(2000, ITEM), (2001, ITEM + " " + text(20)), (2002, ITEM + " " + text(600))]  # contaminated but the last
    out += [(3000, text(40) + " mail a.person@mail.org or Mr John Smith"), (3001, text(40) + " a.person@mail.org")]
    out += [(4000, None), (4001, None), (4002, ""), (None, text(50)), (None, plain[1]), (5000, plain[2]), (5000, text(45)), (5001, "x"), (6000, text(30_000))]
    out += [out[3], out[3]]
    return [(i, t, "en", "s", len(t or "")) for i, t in out]


ITEM = " ".join(f"item{i}" for i in range(20))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows(), SCHEMA).withColumn("k", F.lit("clash")).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def near(texts):
    """Groups of 5-word shingle sets at a similarity of 0.8, by row."""
    sets = []
    for t in texts:
        w = split(SPACED, t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "pii", "bpe"]
    net = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = toxicity.score(docs.withColumn("row", F.lit(1)), net)
    clean = stage["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns and clean.count() == scored.where("predicted = 0").count()
    kept = {r.doc_id for r in clean.collect()}
    assert sum(i in kept for i in range(160) if i % 8) > 130 and sum(i in kept for i in range(0, 160, 8)) < 5

    out = stage["near_copies"](spark, docs, folder)
    assert out.columns == docs.columns
    all_rows = [(r.doc_id, r.text) for r in docs.collect()]
    group, got = near([t for _, t in all_rows]), pairs(out)
    best = {}
    for g, (i, t) in zip(group, all_rows, strict=True):
        if i is not None:
            best[g] = min(best.get(g, i), i)
    want = Counter()
    for g, (i, t) in zip(group, all_rows, strict=True):
        if i is None:
            want[(i, t)] += 1
        elif best[g] == i:
            want[(i, t)] = 1
    assert got == want

    out = stage["decontamination"](spark, docs, folder)
    assert out.columns == docs.columns
    item = split(LETTER, ITEM)
    windows = {tuple(item[i : i + 13]) for i in range(len(item) - 12)}

    def bad(t):
        w = split(LETTER, t)
        hit = {j for i in range(len(w)) if tuple(w[i : i + 13]) in windows for j in range(i, i + 13)}
        return bool(hit) and 20 * len(hit) >= len(w)

    assert pairs(out) == Counter(x for x in all_rows if not bad(x[1])) and bad(ITEM)

    out = stage["pii"](spark, docs, folder)
    assert out.columns == docs.columns and out.count() == docs.count()
    by_id = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    assert "a.person" not in by_id[3000].text + by_id[3001].text and "John" not in by_id[3000].text
    assert by_id[3000].text.split(" mail ")[1].split()[0] == by_id[3001].text.split()[-1]
    assert all(r.n_chars == len(r.text or "") for r in out.collect() if r.text is not None)
    assert {r.text for r in out.where("doc_id in (4000, 4001)").collect()} == {None} and by_id[4002].text == ""

    out = stage["bpe"](spark, docs, folder)
    assert Counter((r.doc_id, r.ids_sha256) for r in out.collect()) == Counter((r.doc_id, r.ids_sha256) for r in bpe.encode(docs, bpe.vocabulary_path()).collect())


def test_run_is_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, f in corpus_pipeline.STAGES:
        before = docs.count()
        docs = f(spark, docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() <= before if name not in ("pii", "bpe") else docs.count() == before
    got = corpus_pipeline.run(spark, folder)
    of = lambda df: Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect())
    assert of(got) == of(docs) and 2002 in {r.doc_id for r in got.collect()} and 2000 not in {r.doc_id for r in got.collect()}


def test_empty_tables(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, none, folder).count() == 0, name
    bench = spark.read.parquet(f"{folder}/benchmark.parquet").limit(0)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert decontamination.drop_contaminated(docs, bench).count() == docs.count()
    assert decontamination.contaminated(docs, bench).where("contaminated or n_items > 0").count() == 0
    assert pii.replace(none, report=False).columns == docs.columns
