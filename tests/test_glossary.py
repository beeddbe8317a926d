"""Glossary expansion against a version that tries every word at every place."""

import random

import pytest

from folioscope.operators import glossary


def inner(c):
    return c.isascii() and c.isalnum()


def brute(query, groups):
    """Every word at every place; then the longest first, cut out of what is still free."""
    text = glossary.normal(query)
    found = []
    for g, words in enumerate(groups):
        for w in words:
            n = glossary.normal(w)
            for a in range(len(text)):
                b = a + len(n)
                if text[a:b] != n or inner(n[0]) and a and inner(text[a - 1]) or inner(n[-1]) and b < len(text) and inner(text[b]):
                    continue
                found.append((a, b, g, n))
    if not found:
        return query, query
    held = {n for *_, n in found}
    more = [w for g in sorted({f[2] for f in found}) for w in groups[g] if glossary.normal(w) not in held]
    free, put = [True] * len(text), {}
    for a, b, g, _ in sorted(found, key=lambda f: (f[0] - f[1], f[0])):
        if all(free[a:b]):
            free[a:b] = [False] * (b - a)
            put[a] = (b, groups[g][0])
    out, at = "", 0
    while at < len(text):
        if at in put:
            at, word = put[at]
            out += word
        else:
            out, at = out + text[at], at + 1
    return " ".join([query, *more]), out


def random_groups(r):
    letters = ["a", "b", "가", "é", "1", "-", " "]
    words = sorted({glossary.normal("".join(r.choices(letters, k=r.randint(1, 4)))) for _ in range(r.randint(4, 14))} - {""})
    r.shuffle(words)
    return [words[i : i + 2] for i in range(0, len(words) - 1, 2)]


def test_automaton_equals_brute_force():
    r = random.Random(8)
    for _ in range(300):
        groups = random_groups(r)
        automaton = glossary.Automaton(glossary.checked(groups) if groups else [])
        for _ in range(20):
            query = "".join(r.choices(["a", "b", "A", "가", "é", "1", "-", " ", "\t", "ａ"], k=r.randint(0, 12)))
            assert automaton.expanded(query) == brute(query, groups), (query, groups)


def test_long_texts_take_one_pass():
    automaton = glossary.Automaton(glossary.checked([["가", "나"], ["가가", "다"]]))
    keywords, sentence = automaton.expanded("가" * 100_000)
    assert sentence == "가가" * 50_000 and keywords.endswith(" 나 다")


def test_operator(spark, monkeypatch):
    groups = [["von", "de"], ["market", "trade"]]
    words = spark.createDataFrame(glossary.checked(groups), "group_no int, pos int, word string, norm string")
    rows = [(1, "Trade de X"), (1, "Trade de X"), (2, None), (None, ""), (3, "trader")]
    got = glossary.expand(spark.createDataFrame(rows, "item_id int, text string"), words, "item_id", "text").collect()
    assert sorted(((r.item_id or 0, r.keyword_text, r.sentence) for r in got), key=str) == sorted(((k or 0, *(brute(t, groups) if t is not None else (None, None))) for k, t in rows), key=str)
    monkeypatch.setattr(glossary, "GLOSSARY_BYTES", 3)
    with pytest.raises(ValueError, match="a glossary of"):
        glossary.expand(words, words, "group_no", "word")
    monkeypatch.undo()
