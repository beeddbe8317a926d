"""The corpus operators against brute force, the tokenizers library and awkward tables."""

import hashlib
import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import bpe, decontamination, embedding_dedup, graph, html_extraction, jaccard_join, license_scan, lm_scoring, pii, toxicity, url_filter, words

LETTER = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def split(pattern, text):
    return pattern.findall((text or "").encode().translate(LOW))


def corpus(seed=3, n=60):
    r = random.Random(seed)
    vocab = ["alpha", "béta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "la", "mu"]
    base = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 60))) for _ in range(n)]
    near = []
    for t in base[:20]:
        w = t.split()
        if w:
            w[r.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    texts = [*base, *near, *base[:5], "", None, "one", "two words", "ONE", "x" * 5000, "a b c d " * 800]
    # repeated, null and clashing keys; extra columns with inner names
    rows = [(i, t, "z", 1, 2.0) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, base[1], "z", 1, 2.0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, k string, n int, score double").repartition(3)


def test_words_match_the_pattern():
    texts = [r[1] for r in corpus()] + ["a\x0bb", "\x1c", "É é", "a-b_c"]
    for table, pattern in ((words.LETTERS, LETTER), (words.SPACED, SPACED)):
        w = words.split_words(pa.array(texts), table)
        got = [[w.data[w.start[i] : w.end[i]].tobytes() for i in range(w.first[r], w.first[r + 1])] for r in range(len(texts))]
        assert got == [split(pattern, t) for t in texts]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)], "src long, dst long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert graph.components(edges.limit(0)).count() == 0


def test_lm_scores(docs):
    rows = [(r.doc_id, split(LETTER, r.text)) for r in docs.select("doc_id", "text").collect()]
    c = [Counter(tuple(w[i : i + k]) for _, w in rows for i in range(len(w) - k + 1)) for k in (1, 2, 3)]
    total = sum(len(w) for _, w in rows)

    def s(w, i):
        top = min(i, 2)
        for k in range(top, 0, -1):
            g = tuple(w[i - k : i + 1])
            if c[k][g] >= 2:
                return math.log(c[k][g] / c[k - 1][g[:-1]]) + (top - k) * math.log(0.4)
        return math.log(c[0][(w[i],)] / total) + top * math.log(0.4)

    want = Counter((d, len(w), round(sum(s(w, i) for i in range(len(w))), 4)) for d, w in rows)
    assert Counter((r.doc_id, r.n_words, round(r.log_score, 4)) for r in lm_scoring.score(docs).collect()) == want


def jaccard_groups(rows, words=4, percent=85):
    sets = []
    for r in rows:
        w = split(SPACED, r.text)
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    want = Counter()
    for i, r in enumerate(rows):
        ids = [rows[j].doc_id for j in range(len(rows)) if group[j] == group[i] and rows[j].doc_id is not None]
        want[(r.doc_id, len(sets[i]), min(ids, default=None))] += 1
    return want


def test_jaccard_groups(docs):
    want = jaccard_groups(docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join(docs).collect()) == want
    kept = jaccard_join.one_of_each(docs, words=4, percent=85)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({k[2] for k in want if k[0] is not None and k[2] is not None})


def test_jaccard_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 6)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    r = random.Random(12)
    shared = [f"s{i}" for i in range(40)]
    texts = []
    for base in range(4):
        words_ = [f"b{base}w{i}" for i in range(30)] + shared
        for _ in range(45):
            w = list(words_)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = f"x{r.randint(0, 5)}"
            texts.append(" ".join(w))
    # a chain: each links with the next only
    texts += [" ".join(f"c{i}" for i in range(k * 4, k * 4 + 60)) for k in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in jaccard_join.join(df).collect())
    want = jaccard_groups(df.collect())
    assert got == want and len({k[2] for k in want}) < len(texts) - 20


def test_divide_skip():
    r = random.Random(1)
    sets = [np.array(sorted(r.sample(range(60), r.randint(0, 40))), dtype=np.uint64) for _ in range(50)]
    lists = jaccard_join.Lists(sets)
    for _ in range(200):
        q = np.array(sorted(r.sample(range(70), r.randint(1, 30))), dtype=np.uint64)
        need = r.randint(1, 20)
        want = [i for i, s in enumerate(sets) if len(np.intersect1d(q, s)) >= need]
        assert sorted(lists.divide_skip(q, need)) == want
        assert sorted(lists.divide_skip(q, need, lambda i: i % 2 == 0)) == [i for i in want if i % 2]
    assert list(jaccard_join.Lists([]).divide_skip(q, 1)) == []


def test_decontamination_both_ways(spark, docs):
    texts = [r[1] for r in corpus()]
    items = [(1, " ".join(texts[3].split()[:20])), (2, "alpha béta"), (3, "Béta"), (4, None), (None, "gamma"), (5, ""), (6, texts[7]), (7, texts[7])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = split(LETTER, t) if i is not None else []
        for a in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[a : a + 13]), set()).add(str(i))
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        w, hit, found = split(LETTER, r.text), set(), set()
        for win, ids in windows.items():
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a : a + len(win)]) == win:
                    hit |= set(range(a, a + len(win)))
                    found |= ids
        want[(r.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))] += 1
    for limit in (1 << 20, 0):
        got = decontamination.contaminated(docs, bench, limit=limit)
        assert Counter(tuple(r) for r in got.collect()) == want
        clean = decontamination.drop_contaminated(docs, bench, limit=limit)
        assert clean.columns == docs.columns and clean.count() == sum(n for k, n in want.items() if not k[5])


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    lib = Tokenizer.from_file(path)
    r = random.Random(2)
    pool = [chr(c) for c in (*range(0x20, 0x17F), *range(0x370, 0x400), 0x85, 0xA0, 0x2160, 0x301, 0x3A3, 0x130, 0x200B, 0xAC00, 0x1F600, 0x10400)]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 50))) for _ in range(300)]
    texts += ["", None, "it's I'LL ''s", "<|endoftext|>a<|startoftext|> b <|endoftext|", "ab" * 3000, "The THE", " \n\t "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in bpe.encode(df, path).collect()}
    back = {x.doc_id: x.text for x in bpe.decode(bpe.encode(df, path), path).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].token_ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert back[i] == lib.decode(ids, skip_special_tokens=False)


def test_bpe_forgets_and_learns_again(monkeypatch):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    lib, v, r = Tokenizer.from_file(path), bpe.Vocabulary(path), random.Random(6)
    pool = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(1, 9))) for _ in range(400)] + ["<|endoftext|>", "x" * 300]
    monkeypatch.setattr(bpe, "CACHE", 60)
    encoder, writer = bpe.Encoder(v), bpe.Writer(v)
    for n in (3, 20, 200, 1, 0, 40, 40, 500):
        texts = [" ".join(r.choices(pool, k=r.randint(0, n))) for _ in range(5)] + [None]
        ids, first = encoder.batch(texts)
        want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:], strict=False)] == want
        assert writer.digests(writer.string, ids, first) == [hashlib.sha256(lib.decode(w, skip_special_tokens=False).encode()).hexdigest() for w in want]
    again = bpe.Encoder(v)
    assert [x.tolist() for x in again.batch([])] == [[], [0]] and again.batch([None, ""])[1].tolist() == [0, 0, 0]


def test_bpe_awkward_tables(spark):
    rows = [(1, "a b", 7, "x"), (1, "a b", 7, "x"), (None, "long " * 200_000, 8, "y"), (2, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, k string")
    got = sorted(tuple(r[:2]) for r in bpe.encode(df.where("doc_id is not null"), bpe.vocabulary_path()).collect())
    assert got == [(1, 2), (1, 2), (2, 0)]
    assert bpe.encode(df.where("doc_id is null"), bpe.vocabulary_path()).first().n_tokens == 200_000
    assert bpe.encode(df.limit(0), bpe.vocabulary_path()).count() == 0


def test_embedding_links(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((120, 16))
    x = np.concatenate([base, base[:40] + 0.1 * r.standard_normal((40, 16)), base[:5]])
    rows = [(i, [float(v) for v in x[i]], "z") for i in range(len(x))] + [(900, None, "z"), (901, [0.0] * 16, "z"), (902, [float("nan")] * 16, "z"), (903, [1.0, None] * 8, "z"), (904, [], "z"), (905, [1.0, 2.0], "z"), (0, [float(v) for v in x[0]], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, w string")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    u = np.concatenate([u, u[:1]])
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    got = embedding_dedup.links(df).collect()
    assert len(got) == len(rows)
    found = sum(g.n_links for g in got)
    assert 0.9 * near.sum() <= found <= near.sum()
    assert all(g.n_links == 0 and g.kept and g.component_id == g.vec_id for g in got if g.vec_id >= 900)
    assert embedding_dedup.links(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [500, 20_000, 10**6, 12 * 10**7])
def test_embedding_recall_at_threshold(n):
    x, y = embedding_dedup.pairs_at(64, 0.9, 2000, 5)
    met = np.zeros(len(x), dtype=bool)
    for seed in range(embedding_dedup.codes_needed(64, n, 0.9)):
        met |= embedding_dedup.meets(embedding_dedup.Code(64, n, seed), x, y)
    assert met.mean() >= 0.99


def test_html():
    page = """<html><head><title>x</title><script>var a="</p>";</script></head><body><header>Site</header><nav><a>menu</a></nav>
    <article><h1>Title &amp; more</h1><p><b>One<br>two   three<p>Four &lt;five&gt;</p><div class="ad">buy</div><section class="comments"><p>nice</p></section></article>
    <footer>&copy; f</footer></body></html>"""
    assert [t for z, t in html_extraction.blocks(page) if z == html_extraction.MAIN] == ["Title & more", "One two three", "Four <five>"]
    assert html_extraction.common([1, 2, 3, 4, 5], [9, 2, 4, 5]).tolist() == [False, True, False, True, True]


def test_html_wrapped_article():
    wrapped = "<body><p>top</p><div class='content with sidebar'><article><p>The whole story.</p></article><p>links</p></div></body>"
    assert html_extraction.main_text(html_extraction.blocks(wrapped), None) == ["The whole story."]
    related = "<main><p>story</p></main><div class='related'><article>another longer story</article></div>"
    assert html_extraction.main_text(html_extraction.blocks(related), None) == ["story"]
    unseen = "<p>story</p><div style='display:none'><div class='related'><article>another longer story</article></div></div>"
    assert html_extraction.main_text(html_extraction.blocks(unseen), None) == ["story"]
    aside = "<p>story</p><aside><article>another longer story</article></aside>"
    assert html_extraction.main_text(html_extraction.blocks(aside), None) == ["story"]


def test_html_differencing(spark):
    def page(own):
        return f"<body><div>Top menu</div><div>{own}</div><p>Say hello</p></body>"

    rows = [(i, f"http://a.org/x/{i}", page(f"own text {i}")) for i in range(6)] + [(10, None, page("q")), (11, "http://b.org/", None), (12, "http://c.org/1", ""), (0, "http://a.org/x/0", page("own text 0"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("z")).withColumn("host", F.lit(1))
    out = html_extraction.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and html_extraction.extract(df.limit(0)).count() == 0
    got = [(r.page_id, r.text) for r in out.collect()]
    assert Counter(got) == Counter([(i, f"own text {i}") for i in (0, 0, 1, 2, 3, 4, 5)] + [(10, "Top menu\n\nq\n\nSay hello"), (11, ""), (12, "")])
    keyless = html_extraction.extract(df.withColumn("page_id", F.lit(None).cast("long"))).collect()
    assert Counter(r.text for r in keyless) == Counter(t for _, t in got)


def test_html_common_lines_are_longest():
    r = random.Random(1)

    def longest(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        return rows[-1][-1]

    for _ in range(300):
        a, b = ([r.randint(0, 4) for _ in range(r.randint(0, 14))] for _ in range(2))
        for most in (1 << 28, 9, 1):
            shared = [x for x, k in zip(a, html_extraction.common(a, b, most), strict=True) if k]
            rest = iter(b)
            assert all(x in rest for x in shared) and len(shared) == longest(a, b)
    assert html_extraction.common([1, 2] * 5000, [2, 1, 1] * 4000).sum() >= 8000


def test_html_nearest_url(spark):
    def page(*own):
        return "<body><div>Site menu</div>" + "".join(f"<p>{x}</p>" for x in own) + "</body>"

    rows = [
        (1, "http://a.org/x/1", page("Menu A", "one")),
        (2, "http://a.org/x/2", page("Menu A", "two")),
        (3, "http://a.org/y/1", page("Menu B", "three")),
        (4, "http://a.org/y/z/2", page("Menu B", "four")),
        (5, "http://a.org/x-y/9", page("five")),
        (6, "http://b.org/", page("alone")),
        (7, "http://a.org/x/1", page("Menu A", "one")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in html_extraction.extract(df).collect()}
    assert got == {1: "one", 2: "two", 3: "three", 4: "four", 5: "five", 6: "Site menu\n\nalone", 7: "one"}
    # the pairing against a search of all pages
    r = random.Random(4)
    paths = [["", *(r.choice("abc") for _ in range(r.randint(1, 5)))] for _ in range(120)]
    pages = spark.createDataFrame([(r.choice(["g.org", "h.org"]), p, i) for i, p in enumerate(paths)], "host string, segs array<string>, x long")
    host = {x.x: x.host for x in pages.collect()}
    prefix = lambda p, q: next((k for k, (a, b) in enumerate(zip(p, q, strict=False)) if a != b), min(len(p), len(q)))
    pairs = {x.x: x.px for x in html_extraction.partners(pages).collect()}
    for i, p in enumerate(paths):
        assert host[pairs[i]] == host[i] and prefix(p, paths[pairs[i]]) == max(prefix(p, q) for j, q in enumerate(paths) if j != i and host[j] == host[i])


def test_html_markup_does_not_overrule():
    text = lambda h, partner=None: html_extraction.main_text(html_extraction.blocks(h), partner)
    named = "<article><h2 id='related-work'>Related work</h2><section id='search-algorithms'><p>Search</p></section><div class='side-effects'>Effects</div><div class='related'>more</div></article>"
    assert text(named) == ["Related work", "Search", "Effects"]
    teaser = "<div>Menu</div><article>Teaser</article><div class='post-body'><p>The long story is here.</p></div>"
    menu = html_extraction.line_hashes(html_extraction.blocks("<div>Menu</div><p>other</p>"))
    assert text(teaser, menu) == ["Teaser", "The long story is here."]
    assert text("<div>Menu</div><p>x</p>", html_extraction.line_hashes(html_extraction.blocks("<div>Menu</div><p>x</p>"))) == []
    assert text("<p>" + "word " * 300_000 + "</p>") == [("word " * 300_000).strip()]


def test_embedding_heavy_filters(spark, monkeypatch):
    """Tiles of heavy filters, told to the tasks and joined, and vectors of two lengths."""
    r = np.random.default_rng(7)
    base = r.standard_normal((6, 12))
    x = [*(base[i % 6] + 0.25 * r.standard_normal(12) for i in range(150)), *r.standard_normal((20, 8))]
    df = spark.createDataFrame([(i, [float(v) for v in y]) for i, y in enumerate(x)], "vec_id long, embedding array<double>")
    unit_ = [y / np.linalg.norm(y) for y in x]
    near = [[i != j and len(a) == len(b) and float(a @ b) >= 0.9 for j, b in enumerate(unit_)] for i, a in enumerate(unit_)]
    for tile, heavy in ((16, 100_000), (16, 0), (1024, 0)):
        monkeypatch.setattr(embedding_dedup, "TILE", tile)
        monkeypatch.setattr(embedding_dedup, "HEAVY", heavy)
        got = {v.vec_id: v.n_links for v in embedding_dedup.links(df).collect()}
        want = {i: sum(n) for i, n in enumerate(near)}
        assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.98 * sum(want.values()) > 500


def test_embedding_recall_does_not_fall():
    """Pairs at exactly the threshold, with the codes of tables of any size."""
    for n in (2_000, 1_000_000, 100_000_000):
        codes = embedding_dedup.codes_needed(64, n, 0.9)
        a, b = embedding_dedup.pairs_at(64, 0.9, 300, 99)
        met = np.zeros(300, dtype=bool)
        for seed in range(codes):
            met |= embedding_dedup.meets(embedding_dedup.Code(64, n, seed), a, b)
        assert met.mean() >= 0.97


def test_license_windows(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n\n1. x"
    isc = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."
    gpl = "This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."
    both = "Released under the MIT License.\n" + gpl
    rows = list(enumerate([bsd, isc, mit, gpl, gpl.replace("GNU", "GNU Lesser").replace("program", "library"), both, "to any person in source and binary forms\nthe free software of the foundation"]))
    got = {r.doc_id: (r.licences, r.n_notices) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: ("BSD-3-Clause", 1), 1: ("ISC", 1), 2: ("MIT", 1), 3: ("GPL-3.0", 1), 4: ("LGPL-3.0", 1), 5: ("GPL-3.0,MIT", 2), 6: ("", 0)}


def test_license_bodies(spark):
    import textwrap

    body = {n + str(i): t for i, (n, _, t) in enumerate(license_scan.BODIES)}
    rows = [(k, "Copyright (c) 2020 A. Person\n\n" + textwrap.fill(t.replace("COPYRIGHT HOLDER", "A. PERSON"), 70).replace("\n", "\n# ") + "\nint main() { return 0; }") for k, t in body.items()]
    rows.append(("none", "software " * 300 + "license permission hereby granted " * 50))
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for i, (name, _, _) in enumerate(license_scan.BODIES):
        assert got[name + str(i)].licences == name and got[name + str(i)].best_dice > 0.85
    assert got["none"].licences == ""


def test_license_passes_over_nothing(spark):
    """Against a scan of every unit with every template."""
    r = random.Random(9)
    pool = [w for _, _, t in license_scan.TEMPLATES for w in license_scan.words_of(t)]
    texts = []
    for _ in range(300):
        w = license_scan.words_of(r.choice(license_scan.TEMPLATES)[2])
        for _ in range(r.randint(0, 4)):
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 1)] = [r.choice(pool)][: r.randint(0, 1)]
        texts.append("Some text. " + " ".join(w) + ".")
    texts += ["", None, "Long. " * 50_000 + "Released under the MIT License."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("licences", F.lit("x"))
    got = {x.doc_id: x for x in license_scan.scan(df, notices=[]).collect()}
    sets = [set(license_scan.bigrams_of(t)) for _, _, t in license_scan.TEMPLATES]
    for i, t in enumerate(texts):
        best = 0.0
        for unit in re.split(license_scan.UNIT_END, (t or "").lower()):
            g = set(license_scan.bigrams_of(unit))
            best = max([best, *(2 * len(g & s) / (len(g) + len(s)) for s in sets if g)])
        if best >= 0.8:
            assert got[i].n_notices >= 1 and got[i].best_dice >= round(best, 6), t
    assert license_scan.scan(df.limit(0)).count() == 0 and license_scan.scan(df.withColumn("doc_id", F.lit(None).cast("long"))).count() == len(texts)


def test_license_scan(spark):
    rows = [(1, "Intro. Licensed under the Apache License, Version 2.0.\nmore"), (2, "licensed under cc by-nc 4.0!\nReleased under the MIT License."), (3, None), (4, "the license of the public"), (5, ""), (1, "x")]
    got = Counter((r.doc_id, r.licences, r.n_notices) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(1, "Apache-2.0", 1), (2, "CC-BY-NC-4.0,MIT", 2), (3, "", 0), (4, "", 0), (5, "", 0), (1, "", 0)])


def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", 3)
    monkeypatch.setattr(url_filter, "HASHES", 2)
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("hash(key) % 3 = 0")
    c = url_filter.Cascade(listed, universe)
    assert len(c.levels) > 2
    told = universe.withColumns(c.columns()).where(c.holds(F.col("key"))).select("key")
    assert told.exceptAll(listed).count() == 0 and told.count() == listed.count()


def test_cascade_gives_up(spark, monkeypatch):
    universe = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("hash(key) % 3 = 0")
    assert url_filter.Cascade(listed, universe).whole
    assert not url_filter.Cascade(listed, universe, 8).whole and not url_filter.Cascade(listed, universe, 8).levels
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", 1)
    monkeypatch.setattr(url_filter, "HASHES", 4)
    monkeypatch.setattr(url_filter, "MOST_LEVELS", 2)
    assert not url_filter.Cascade(listed, universe).whole
    empty = url_filter.Cascade(listed.limit(0), universe)
    assert empty.whole and not empty.levels
    pages = universe.select(F.concat(F.lit("http://"), "key", F.lit("/")).alias("url"), F.lit(None).cast("long").alias("page_id"), F.lit("x").alias("verdict"))
    got = url_filter.judge(pages.union(pages), [], listed.union(listed)).where("verdict = 'block'")
    assert got.count() == 2 * listed.count() and url_filter.judge(pages.limit(0), [], listed).count() == 0
    assert url_filter.judge(pages, [], listed.limit(0)).where("verdict = 'block'").count() == 0


def test_url_rules(spark):
    urls = [None, "", "no scheme", "HTTP://WWW.Example.ORG/es/1?x", "http://example.org", "http://a.com/de/", "http://x.net/p#f", "http://www.free-bets.example.com/en/", "http://a.org/es/"]
    listed = spark.createDataFrame([("free-bets.example.com",)], "key string")
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = [("", "", None, "allow")] * 3 + [("www.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "", None, "allow"), ("a.com", "/de/", "com/de/", "block"), ("x.net", "/p", None, "allow"), ("www.free-bets.example.com", "/en/", None, "block"), ("a.org", "/es/", "org/", "allow")]
    for limit in (1 << 20, -1):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, url_filter.RULES, listed, limit=limit).collect()}
        assert [got[i] for i in range(len(urls))] == want


def test_pii_letters_and_short_addresses(spark):
    found = ["sk-" + "abcdefghij" * 2, "ghp_" + "Abcdef" * 6, "AKIA" + "ABCDEFGH" * 2, "abcdef" * 6, "2001:db8::1", "fe80::1", "::1", "2001:db8::", "2001:DB8:A::B:C"]
    plain = ["std::vec a::zz", "at a:b or ::", "task-abcdefghijklmnopqrstuvwxyz"]
    df = spark.createDataFrame(list(enumerate([f"see {x} there" for x in found] + plain)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.replace(df).collect()}
    for i, x in enumerate(found):
        kind = "secret" if i < 4 else "ipv6"
        assert out[i].text != f"see {x} there" and (out[i].n_entities, out[i].entity_kinds) == (1, kind)
    assert [out[len(found) + i].text for i in range(len(plain))] == plain


def test_pii(spark):
    rows = [(1, "Mr. John Smith: (415) 555-1234, a.b@c.org and A.B@C.ORG; card 4111 1111 1111 1111", 9), (2, "4111-1111-1111-1111 from 10.20.30.40, Mr John Smith", 9), (3, None, 9), (4, "clean 2.0 text", 9), (1, "078-05-1120 and " + "ab12" * 10, 9), (None, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_entities int")
    out = pii.replace(df)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "n_entities", "entity_kinds"] and len(got) == len(rows)
    joined = " ".join(r.text or "" for r in got)
    for secret in ("John", "Smith", "555-1234", "a.b@c", "A.B@C", "4111 1111", "10.20.30.40", "078-05-1120", "ab12ab12"):
        assert secret not in joined
    one = next(r.text for r in got if r.text and r.text.startswith("Mr."))
    two = next(r.text for r in got if r.text and " from " in r.text)
    card = one.rsplit("card ", 1)[1]
    assert two.startswith(card.replace(" ", "-")) and two.endswith(one[4 : one.index(":")])
    assert re.search(r"\(\d{3}\) \d{3}-\d{4}, ([a-z]\.[a-z]@[a-z]\.org) and ", one) and one.count("@") == 2
    assert {r.text for r in got if r.n_entities == 0} == {None, "clean 2.0 text", ""}
    assert pii.replace(df, report=False).columns == df.columns and pii.replace(df.limit(0)).count() == 0


def test_pii_persons(spark):
    rows = [
        (1, "Mr. John Smith met Frau Anna Berger-Klein. Mr Smith said: John Smith knows Dr. Jane Doe, Mr JOHN SMITH and Johnathan Smithson."),
        (2, "г-н Иван Петров и Mrs Smith; Herr Smith"),
        (3, "call 06 12 34 56 78 or 030 1234567, not 10 12 34 56 78 or 0.5 1234567"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.replace(df, key="k").collect()}
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Frau (\w+) (\w+)\. Mr (\w+) said: (\w+) (\w+) knows Dr\. (\w+) (\w+), Mr ([A-Z]+) ([A-Z]+) and Johnathan Smithson\.", out[1])
    given, family = m[1], m[2]
    assert (m[5], m[6], m[7], m[10], m[11]) == (family, given, family, given.upper(), family.upper())
    assert m[3].endswith("a") and len({m[2], m[4], m[9]}) == 3 and not {"John", "Smith", "Anna", "Jane", "Doe"} & set(m.groups())
    assert re.fullmatch(rf"г-н [А-Яа-я]+ [А-Яа-я]+ и Mrs {family}; Herr {family}", out[2]) and "Петров" not in out[2]
    assert re.fullmatch(r"call \d\d \d\d \d\d \d\d \d\d or \d\d\d \d{7}, not 10 12 34 56 78 or 0\.5 1234567", out[3])
    assert "06 12 34" not in out[3] and "030 1234567" not in out[3]
    other = {r.doc_id: r.text for r in pii.replace(df, key="l").collect()}
    assert all(other[i] != out[i] for i in out)


def test_mac_is_hmac(spark):
    import hmac

    for key in ("k", "x" * 200):
        got = spark.range(1).select(pii._mac(key, F.lit("grüße"))).first()[0]
        assert got == hmac.new(key.encode(), "grüße".encode(), "sha512").hexdigest()


def test_pii_full_formats(spark, monkeypatch):
    """All values of a format are entities: surrogates grow instead of failing."""
    monkeypatch.setattr(pii, "LONGER", 1)
    e = spark.createDataFrame([("phone", f"{i}") for i in range(10, 20)] + [("ipv6", f"{i:04x}::") for i in range(3)], "kind string, value string")
    got = pii.surrogates(e, "key").collect()
    assert len({(r.kind, r.surrogate) for r in got}) == 13 and all(len(r.surrogate) >= 2 for r in got)
    taken = {f"{i}" for i in range(10, 20)}
    assert not taken & {r.surrogate for r in got} and all(r.surrogate[0] == "1" for r in got if r.kind == "phone")
    text = "+1 1" + "0" * 7
    df = spark.createDataFrame([(1, text), (2, "x " * 200_000 + text), (3, "a@b.org-10.0.0.1 078-05-1120")], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.replace(df).collect()}
    assert out[2].text == "x " * 200_000 + out[1].text and out[1].text != text and out[3].n_entities >= 2


def test_surrogates_are_distinct(spark):
    e = spark.createDataFrame([("ssn", f"{i:03d}") for i in range(300)], "kind string, value string")
    got = pii.surrogates(e, "key").collect()
    assert len({r.surrogate for r in got}) == 300 and not {r.surrogate for r in got} & {f"{i:03d}" for i in range(300)}


def test_gradients(monkeypatch):
    monkeypatch.setattr(toxicity, "F4", np.float64)
    w = words.split_words(pa.array(["a bb ccc dd", "bb ee a"]), words.SPACED)
    net = toxicity.Network(np.unique(w.hash)[:3])
    for k in net.NAMES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    lex = toxicity.Lexicon(w, net.known)
    spot = w.first[:-1, None] + np.arange(5)
    mask = spot < w.first[1:, None]
    index, d = lex.of[np.minimum(spot, len(lex.of) - 1)], np.array([1.0, -0.7])

    def run():
        x = net.inputs(lex)
        return net.forward(np.stack([x @ net.wx[k] + net.bx[k] for k in (0, 1)]), index, mask, keep=True), x

    (_, saved), x = run()
    grads = net.backward(lex, x, len(lex.size), mask, saved, d)
    for k in net.NAMES:
        p = getattr(net, k)
        for at in map(tuple, np.argwhere(np.abs(grads[k]) > 1e-9)[:4]):
            old, both = p[at], []
            for e in (1e-5, -1e-5):
                p[at] = old + e
                both.append((run()[0][0] * d).sum())
            p[at] = old
            assert abs((both[0] - both[1]) / 2e-5 - grads[k][at]) < 1e-6


def test_toxicity_learns(spark):
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(150)]
    rows, labels = [], []
    for i in range(400):
        w, bad = [r.choice(vocab) for _ in range(r.randint(20, 120))], i % 4 == 0
        for _ in range(3 if bad else 0):
            w[r.randrange(len(w))] = r.choice(["vile", "nasty"])
        rows.append((i, " ".join(w), "z"))
        labels.append((i, int(bad)))
    rows += [(500, None, "z"), (501, "", "z"), (None, "vile", "z"), (3, rows[3][1], "z")]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    net = toxicity.fit(docs, lab)
    got = toxicity.score(docs, net).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 for g in got)
    held = [g for g in got if g.held_out and g.doc_id is not None and g.doc_id < 400]
    assert sum(g.predicted == (g.doc_id % 4 == 0) for g in held) >= 0.95 * len(held)
    clean = toxicity.drop_toxic(docs, net)
    assert clean.columns == docs.columns and clean.count() == sum(1 - g.predicted for g in got)
    assert toxicity.fit(docs, lab.limit(0)) is None and toxicity.score(docs, None).agg(F.max("score")).first()[0] == 0


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert lm_scoring.score(none).count() == jaccard_join.join(none).count() == license_scan.scan(none).count() == bpe.encode(none, bpe.vocabulary_path()).count() == 0
    assert not any(unicodedata.category(c) == "Cs" for c in "")


def test_html_stray_quotes_and_unclosed_markup():
    text = lambda h: html_extraction.main_text(html_extraction.blocks(h), None)
    assert text('<article><p><a href="x"">One</a></p><p>Two</p></article>') == ["One", "Two"]
    assert text("<article><p title=it's>Body one</p><p>Body two</p></article>") == ["Body one", "Body two"]
    assert text('<article><p class=a"b>One</p><p id=\'x\'\'>Two</p><p =">Three</p></article>') == ["One", "Two", "Three"]
    assert text("<article><p>One</p><![CDATA[the end") == ["One", "the end"]
    assert text('<article><p title="a > b">One</p><img alt=\'<p>no</p>\'><p data-x = "1">Two</p></article>') == ["One", "Two"]
    assert text('<article><p>One</p><p title="never closed>Two</p></article>') == ["One"]


@pytest.mark.parametrize("name", ["comments-list", "comment-body", "user_comment", "related-posts", "advert-box", "social-share", "ad-slot", "share-buttons", "newsletter-signup", "promo_banner", "recommended-articles"])
def test_html_boxes_inside_an_article_go(name):
    for attribute in (f'class="{name}"', f"id='{name}'", f"class=big-{name}"):
        page = f"<article><h1>Title</h1><p>Body</p><section {attribute}><p>Reader: nice!</p></section><p>End</p></article>"
        assert html_extraction.main_text(html_extraction.blocks(page), None) == ["Title", "Body", "End"], attribute


@pytest.mark.parametrize("name", ["related-work", "side-effects", "social-sciences", "ad-hoc", "share-price", "header-text", "commentary", "promotion", "form-and-function"])
def test_html_parts_of_an_article_stay(name):
    page = f'<article><h1>Title</h1><section class="{name}"><p>Body</p></section></article>'
    assert html_extraction.main_text(html_extraction.blocks(page), None) == ["Title", "Body"]


@pytest.mark.parametrize("name", ["Attribution", "Attribution-ShareAlike", "Attribution-NoDerivatives", "Attribution-NonCommercial", "Attribution-NonCommercial-ShareAlike", "Attribution-NonCommercial-NoDerivatives"])
def test_licences_of_one_family_are_told_apart(spark, name):
    sign = {"Attribution": "BY", "ShareAlike": "SA", "NoDerivatives": "ND", "NonCommercial": "NC"}
    want = "-".join(["CC", *(sign[x] for x in name.split("-")), "4.0"])
    texts = [f"This work is licensed under a Creative Commons {name} 4.0 International License.", f"x y. Licensed under {want.replace('-', ' ', 1).replace('-4.0', ' 4.0')}.\nz", f"words before this work is licensed\nunder a Creative Commons {name}\n4.0 International License and after"]
    got = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    assert [(r.licences, r.n_notices) for r in sorted(got)] == [(want, 1)] * 3


def test_divide_skip_with_a_bound_for_each_place():
    r = random.Random(3)
    sets = [np.array(sorted(r.sample(range(10**6), 30) + r.sample(range(10**6, 10**6 + 60), 50)), dtype=np.uint64) for _ in range(60)]
    lists = jaccard_join.Lists(sets)
    for q in sets[:20]:
        q = np.array(sorted({*q.tolist(), *(int(x) - 1 for x in q[:20] if x)}), dtype=np.uint64)  # next to items that are in no list
        need = np.array([r.randint(35, 60) for _ in sets])
        want = [i for i, s in enumerate(sets) if len(np.intersect1d(q, s)) >= need[i]]
        assert sorted(lists.divide_skip(q, need)) == want


def test_components_of_merged_partitions(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(400) if i % 10] + [(5, 395), (1000, 1000)]
    frame = spark.createDataFrame(edges, "src long, dst long").repartition(16)
    forest = graph.Forest()
    for a, b in edges:
        forest.join(a, b)
    want = {x: forest.find(x) for e in edges[:-1] for x in e}
    for most in (1 << 18, 100, 1):
        monkeypatch.setattr(graph, "TASK_EDGES", most)
        before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
        assert {r.node: r.component for r in graph.components(frame).collect()} == want
        jobs = len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before))
        if most == 1 << 18:
            few = jobs
    assert few < jobs


def test_shingles_of_a_search_move_only_to_their_groups(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*words[:i], f"x{i}", *words[i:]])) for i in range(20)]
    out, links = jaccard_join.near_sets(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 4, 85)
    assert "items" not in out.columns and out.count() == 20
    assert links.select("component").distinct().count() == 1 and links.count() == 20
