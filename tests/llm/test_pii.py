"""Names over the whole corpus against a plain Python version, check digits and large texts."""

import random
import re

import pytest

from folioscope.llm import pii

TITLES = {"Mr": "m", "Ms": "f", "Dr": "n", "Miss": "f"}
WORDS = ["John", "Jane", "Robin", "Smith", "Doe", "Stone", "met", "said", "the", "and", "saw"]


def grams(tokens):
    for i in range(len(tokens)):
        for n in (2, 3):
            g = tokens[i : i + n]
            if len(g) == n and all(w[0].isupper() for w in g):
                yield tuple(g)


def titled(tokens):
    """(start, end) of titles with their names."""
    out, i = [], 0
    while i < len(tokens):
        j = i + 1
        while j < len(tokens) and j <= i + 3 and tokens[j][0].isupper():
            j += 1
        if tokens[i] in TITLES and j > i + 1:
            out.append((i, j))
            i = j
        else:
            i += 1
    return out


def plainly(texts):
    """Each text as words that stay and (kind, gender, word) of those that are replaced."""
    split = [t.split(" ") for t in texts]
    found = [titled(t) for t in split]
    genders, given, known = {}, {}, set()
    for t, spans in zip(split, found):
        for a, b in spans:
            name, g = tuple(t[a + 1 : b]), TITLES[t[a]]
            if len(name) > 1:
                if g != "n":
                    genders.setdefault(name, set()).add(g)
                    given.setdefault(name[0], set()).add(g)
                if t[a] != "Miss":
                    known.add(name)

    def gender(told, name):
        if told != "n":
            return told
        for said in (genders.get(name, ()), given.get(name[0], ())):
            if len(said) == 1:
                return min(said)
        return "n"

    def replaced(told, name):
        return [("given", gender(told, name), name[0])] + [("family", "", w) for w in name[1:]]

    out = []
    for t, spans in zip(split, found):
        names = {}
        hits = {g for g in grams(t) if g in known}
        for name in hits:
            names[name] = "n"
        for name in {tuple(t[a + 1 : b]) for a, b in spans if b - a > 2}:
            names[name] = min(TITLES[t[a]] for a, b in spans if tuple(t[a + 1 : b]) == name)
        families = {n[-1] for n in hits} | {t[b - 1] for a, b in spans if t[a] != "Miss"}
        made, i = [], 0
        starts = dict(spans)
        while i < len(t):
            if i in starts:
                name = tuple(t[i + 1 : starts[i]])
                made += [t[i]] + (replaced(TITLES[t[i]], name) if len(name) > 1 else [("family", "", name[0])])
                i = starts[i]
                continue
            end = min([a for a in starts if a > i], default=len(t))
            for n in (3, 2, 1):
                name = tuple(t[i : i + n])
                if i + n <= end and (name in names or (n == 1 and name[0] in families)):
                    made += replaced(names[name], name) if n > 1 else [("family", "", name[0])]
                    i += n
                    break
            else:
                made.append(t[i])
                i += 1
        out.append(made)
    return out


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_names_equal_a_plain_version(spark, monkeypatch, limit):
    monkeypatch.setattr(pii, "BROADCAST_BYTES", limit)
    r = random.Random(limit)
    texts = [" ".join(r.choices([*TITLES, *WORDS], [2, 2, 2, 1, *[3] * 6, *[4] * 5], k=r.randint(1, 14))) for _ in range(150)]
    texts += ["Dr Jane Stone met Robin Doe", "Ms Jane Stone saw Smith", "Mr Robin Doe said the end", "Jane Stone", "Miss Robin Smith and Robin Smith", "Robin Smith"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x for x in pii.replace(df, key="k").collect()}
    assert len(got) == len(texts)
    stands = {}
    for i, want in enumerate(plainly(texts)):
        new = got[i].text.split(" ")
        assert len(new) == len(want), (texts[i], got[i].text)
        for w, x in zip(want, new):
            if isinstance(w, str):
                assert w == x, (texts[i], got[i].text)
            else:
                assert stands.setdefault(w, x) == x, (texts[i], got[i].text)
        n = sum(isinstance(w, tuple) for w in want)
        assert (got[i].n_entities > 0, got[i].entity_kinds) == (n > 0, "person" if n else "")
    for kind in ("given", "family"):
        of = [x for w, x in stands.items() if w[0] == kind]
        assert len(of) == len(set(of)) and not {x for x in of if x in WORDS or x in TITLES}
    assert all(any(x.lower().endswith(e) for e in pii._ENDS[w[1], "latin"]) for w, x in stands.items() if w[0] == "given")


def test_one_person_whatever_the_title(spark):
    texts = ["Mr. John Smith met. Later Smith said no; Smith's car, Smith-Jones and O'Smith", "John Smith and Ann Roe live at 12 Main Street", "Dr. Jane Doe or Ms Jane Doe", "JANE DOE", "Sr Software Engineer", "a Software Engineer", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.replace(df, key="k").collect()}
    given, family = re.match(r"Mr\. (\w+) (\w+) ", out[0]).groups()
    assert out[0] == f"Mr. {given} {family} met. Later {family} said no; {family}'s car, Smith-Jones and O'Smith" and "Smith" not in family
    assert out[1] == f"{given} {family} and Ann Roe live at 12 Main Street"
    m = re.fullmatch(r"Dr\. (\w+ \w+) or Ms (\w+ \w+)", out[2])
    assert m[1] == m[2] != "Jane Doe" and out[3] == m[1].upper()
    assert out[4] != texts[4] and (out[5], out[6], out[7]) == (texts[5], None, "")


def test_check_digits_of_accounts(spark):
    def valid(x):
        x = x.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1

    right = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR14 2004 1010 0505 0001 3M02 606"]
    wrong = ["DE00 3704 0044 0532 0130 00"]
    df = spark.createDataFrame(list(enumerate(right + wrong)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.replace(df, key="k").collect()}
    for i, x in enumerate(right + wrong):
        y = out[i].text
        assert out[i].entity_kinds == "iban" and y != x and y[:2] == x[:2] and re.sub(r"\w", "x", y) == re.sub(r"\w", "x", x)
        assert i >= len(right) or (valid(x) and valid(y))
        assert [c.isdigit() for c in y] == [c.isdigit() for c in x]


def test_many_entities_in_one_text(spark):
    mails = [f"user{i}@example.org" for i in range(1500)]
    text = "Mr Alan Hill wrote to " + ", ".join(mails) + "; Alan Hill " * 500
    df = spark.createDataFrame([(1, text, "a"), (1, text, "b")], "doc_id long, text string, __h string")
    a, b = pii.replace(df, key="k").collect()
    assert a.text == b.text and {a["__h"], b["__h"]} == {"a", "b"} and a.n_entities == 2001 and a.entity_kinds == "email,person"
    new = re.findall(r"[\w.]+@[\w.]+", a.text)
    assert len(set(new)) == 1500 and not set(new) & set(mails) and "Alan" not in a.text and "Hill" not in a.text
