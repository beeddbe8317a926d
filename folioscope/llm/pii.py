"""PII: detected entities are replaced by keyed surrogates of the same type and format.

Detection is one pattern of alternatives; an entity's type and its canonical value (the same for
all spellings) follow from its text.  The canonical values of the corpus get surrogates from a
keyed hash (HMAC): digits for digits, letters of the same script for letters, names of the same gender.
A surrogate that is another entity of the corpus, or another entity's surrogate, is drawn again,
so different entities stay different and every mention of one entity gets the same surrogate,
written as the mention was.  Where a format has no free value left, surrogates grow longer (an
address becomes a full IPv6 address), so no table of entities is too large.

Names of persons are replaced word by word: "Mr Smith" keeps the family name that "Mr John Smith"
has got.  Persons are found by a title.  A full name found so is replaced without a title in every
text of the corpus, and the family name alone in texts that name the person.  A title that tells no
gender takes it from the corpus (`resolved`), so "Dr Jane Doe" is "Ms Jane Doe".  Only DataFrame
functions are used.
"""

from __future__ import annotations

import hashlib
import warnings
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import BROADCAST_BYTES, cut

#: Setting that holds the key; another key gives unrelated surrogates.
KEY_SETTING = "spark.folioscope.pii.key"
#: The key where the setting is not made, as in tests: anybody can compute its surrogates.
KEY = "folioscope-surrogates-1"
#: Draws after which surrogates are longer than what they stand for.
LONGER = 8

_TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "Господин", "г-н", "Г-н"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "Госпожа", "г-жа", "Г-жа"],
    "n": ["Dr", "Prof"],
}
#: Titles that are common words as well: names behind them are replaced there, and full ones in the same text, but nowhere else.
_UNSURE = ["Miss", "Sr"]
#: Ends of made-up given names by gender and script, and syllables of names: lists of our own choice.
_ENDS = {
    ("m", "latin"): "ban den fin gor kas lim mir nel pas ron".split(),
    ("f", "latin"): "ba da fa ga la ma na ra sa va".split(),
    ("n", "latin"): "by dy fy ky ly my ny py ry sy".split(),
    ("m", "cyrillic"): "бан вис дим гор лев мир нел пас рон сам".split(),
    ("f", "cyrillic"): "ба ва да га ла ма на ра са та".split(),
    ("n", "cyrillic"): "би ви ди ги ли ми ни ри си ти".split(),
}
_SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до за ка ко ла ле ло ма ме мо на не но па по ра ре ро са со".split(),
}

_EDGE = r"(?<![\p{L}\p{N}._%+\-@])"
#: IPv6 with one run of zero groups left out: some groups before :: and as many after it as there is room for.
_SHORT_V6 = "(?:" + "|".join(f"(?:[0-9A-Fa-f]{{1,4}}:){{{n}}}(?::[0-9A-Fa-f]{{1,4}}){{1,{7 - n}}}" for n in range(1, 7)) + "|(?:[0-9A-Fa-f]{1,4}:){1,7}:|:(?::[0-9A-Fa-f]{1,4}){1,7})"
#: A word of a name: John, O'Brien, Jean-Pierre or JOHN.
_NAME = r"(?:\p{Lu}(?:\p{Ll}+|['’]\p{Lu}\p{Ll}+)(?:[\-'’]\p{Lu}?\p{Ll}+)*|\p{Lu}{2,}(?:[\-'’]\p{Lu}+)*)(?!\p{L})"
#: Types in order of preference and what they look like (Java patterns).
PATTERNS = {
    "email": _EDGE + r"[\p{L}\p{N}._%+\-]++@(?:[\p{L}\p{N}](?:[\p{L}\p{N}\-]{0,62})\.){1,8}\p{L}{2,24}",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}_\-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![\p{L}\p{N}_])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])"
    # national numbers: 06 12 34 56 78 and 030 1234567
    r"|(?<![\d.,+\-/] )(?<![\d.,+\-/])0\d(?:[ .]\d{2}){4}(?!\d|[, ]\d)|(?<![\d.,+\-/] )(?<![\d.,+\-/])0[1-9]\d{1,3}[ /]\d{6,8}(?!\d|[, ]\d)",
    "card": r"(?<![\d.\-])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){2,3}(?:[ \-]\d{1,3})?|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)",
    "ipv4": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)",
    "ipv6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|(?<![\p{L}\p{N}:])" + _SHORT_V6 + r"(?![\p{L}\p{N}:])",
    "person": r"(?<![\p{L}\p{N}])(?:" + "|".join(t for ts in _TITLES.values() for t in ts) + rf")\.? {_NAME}(?: {_NAME}){{0,2}}",
}
PATTERN = "(?:" + "|".join(PATTERNS.values()) + ")"
#: Two name words or more in a row, in which untitled names are looked up.
RUN = rf"(?<![\p{{L}}\p{{N}}]){_NAME}(?: {_NAME})+"
#: What every entity holds: a quick test for texts without any.
HINT = "[0-9@]|sk-|gh[pousr]_|AKIA|[0-9A-Fa-f]{32}|::|[0-9A-Fa-f]:[0-9A-Fa-f]|" + "|".join(t for ts in _TITLES.values() for t in ts)


def kind_of(e: Column) -> Column:
    """The first type whose pattern is the whole entity."""
    out = F.lit("person")
    for name, p in list(PATTERNS.items())[:-1][::-1]:
        out = F.when(e.rlike("^(?:" + p + ")$"), F.lit(name)).otherwise(out)
    return out


def _title(e: Column) -> Column:
    return F.regexp_extract(e, r"^(\S+) ", 1)


def _script(e: Column) -> Column:
    return F.when(e.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def canonical(e: Column, kind: Column) -> Column:
    """One value for all spellings of an entity that is no person."""
    return (
        F.when(kind.isin("ssn", "phone", "card"), F.regexp_replace(e, "[^0-9]", ""))
        .when(kind == "iban", F.replace(e, F.lit(" "), F.lit("")))
        .when((kind == "secret") & ~e.rlike("^[0-9A-Fa-f]+$"), e)
        # shortened addresses have whole groups, so that few digits don't run out of surrogates
        .when((kind == "ipv6") & e.contains("::"), F.array_join(F.transform(F.split(F.lower(e), ":"), lambda g: F.when(g != "", F.lpad(g, 4, "0")).otherwise(g)), ":"))
        .otherwise(F.lower(e))
    )


def _name_words(e: Column) -> Column:
    return F.split(F.regexp_replace(e, r"^\S+ ", ""), " ")


def mention(e: Column, kind: Column) -> Column:
    """(of, value): what an entity means.  A full name is a person (gender by title|words), a single one a family name."""
    title, words = F.rtrim(_title(e), F.lit(".")), _name_words(e)
    gender = F.when(title.isin(_TITLES["m"]), "m").when(title.isin(_TITLES["f"]), "f").otherwise("n")
    of = F.when((kind == "person") & (F.size(words) == 1), "family").otherwise(kind)
    value = F.when(of == "person", F.concat_ws("|", gender, F.lower(F.array_join(words, " ")))).when(of == "family", _family(F.get(words, F.lit(0)))).otherwise(canonical(e, kind))
    return F.struct(of.alias("of"), value.alias("value"))


def _family(w: Column) -> Column:
    return F.concat_ws("|", _script(w), F.lower(w))


def _parts(gender: Column, words: Column) -> Column:
    """(kind, value) of a person's words: gender|script|given, then script|family."""

    def part(w: Column, i: Column) -> Column:
        return F.struct(F.when(i == 0, "given").otherwise("family").alias("kind"), F.concat_ws("|", F.when(i == 0, gender), _family(w)).alias("value"))

    return F.transform(words, part)


def resolved(persons: DataFrame) -> DataFrame:
    """value, name, gender of distinct persons (value: gender by title|name).

    Where the title tells no gender it is that of the same full name elsewhere, else that of the given
    name, if titles agree on it in the whole corpus; else n.  A name with titles of both genders is two persons.
    """
    title, name = F.substring_index("value", "|", 1), F.substring_index("value", "|", -1)
    rows = persons.select("value", title.alias("title"), name.alias("name"), F.substring_index(name, " ", 1).alias("given"))
    told = rows.where("title != 'n'")
    agreed = lambda by: told.groupBy(by).agg(F.min("title").alias(f"of_{by}"), F.max("title").alias("__last")).where(F.col(f"of_{by}") == F.col("__last")).drop("__last")
    rows = rows.join(agreed("name"), "name", "left").join(agreed("given"), "given", "left")
    return rows.select("value", "name", F.when(F.col("title") != "n", F.col("title")).otherwise(F.coalesce("of_name", "of_given", F.lit("n"))).alias("gender"))


def _runs(t: Column) -> Column:
    """Two and three name words in a row, wherever they stand in t, distinct."""

    def grams(words: Column, n: int) -> Column:
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    runs = F.transform(F.regexp_extract_all(t, F.lit(RUN), F.lit(0)), lambda r: F.split(r, " "))
    return F.array_distinct(F.flatten(F.transform(runs, lambda w: F.concat(grams(w, 2), grams(w, 3)))))


def _bounded(df: DataFrame, width: Column) -> DataFrame:
    """A stored table, marked for broadcast if its rows of `width` bytes are small together."""
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if size + 64 * n <= BROADCAST_BYTES else df


def _mac(key: str, message: Column) -> Column:
    """HMAC-SHA-512 in hexadecimal digits."""
    raw = key.encode()
    block = (raw if len(raw) <= 128 else hashlib.sha512(raw).digest()).ljust(128, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "utf-8")), 512))), 512)


def _hexes(key: str, seed: Column) -> Column:
    """256 hexadecimal digits from a keyed hash."""
    return F.concat(*[_mac(key, F.concat_ws("|", seed, F.lit(i))) for i in range(2)])


def _stream(hexes: Column) -> Column:
    """64 numbers from 0 to 65535."""
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substr(hexes, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))


def _at(stream: Column, i: Column) -> Column:
    return F.get(stream, F.pmod(i, F.lit(64)))


def _letters(n: Column, first: str, size: int) -> Column:
    points = F.array(*[F.lit(chr(ord(first) + i)) for i in range(size)])
    return F.get(points, F.pmod(n, F.lit(size)))


def _alike(value: Column, stream: Column) -> Column:
    """Each digit, and each letter by script and case, replaced by one of its sort."""

    def one(c: Column, i: Column) -> Column:
        n = _at(stream, i)
        return (
            F.when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string"))
            .when(c.rlike(r"\p{IsCyrillic}"), F.when(c.rlike(r"\p{Lu}"), _letters(n, "А", 32)).otherwise(_letters(n, "а", 32)))
            .when(c.rlike(r"\p{IsGreek}"), F.when(c.rlike(r"\p{Lu}"), _letters(n, "Α", 17)).otherwise(_letters(n, "α", 17)))
            .when(c.rlike(r"\p{Lu}"), _letters(n, "A", 26))
            .when(c.rlike(r"\p{L}"), _letters(n, "a", 26))
            .otherwise(c)
        )

    return F.array_join(F.transform(_chars(value), one), "")


def _chars(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def _mod97(value: Column) -> Column:
    """Remainder by 97 of digits and letters A-Z (10 to 35)."""
    return F.aggregate(_chars(value), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits, the last one undoubled."""
    rev = F.reverse(_chars(digits))
    each = F.transform(rev, lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def surrogate(kind: Column, value: Column, stream: Column, domain_stream: Column, draw: int) -> Column:
    """The canonical surrogate of a canonical value; streams: numbers from its and its domain's keyed hash."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    top = F.substring_index(domain, ".", -1)
    name = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    of_domain = F.concat(_alike(name, domain_stream), top)
    more = F.lit("") if draw < 4 else F.array_join(F.transform(F.sequence(F.lit(1), F.lit(draw)), lambda i: _letters(_at(stream, i + 40), "a", 26)), "")
    email = F.concat(_alike(local, stream), more, F.lit("@"), of_domain)
    octets = [F.pmod(_at(stream, F.lit(i)), F.lit(223 if i == 0 else 256)) + (1 if i == 0 else 0) for i in range(4)]
    address = F.concat_ws(":", *[F.lower(F.lpad(F.hex(_at(stream, F.lit(i)).cast("long")), 4, "0")) for i in range(8, 16)])
    extra = F.concat(F.lit(""), *[F.pmod(_at(stream, F.lit(40 + i)), F.lit(10)).cast("string") for i in range(draw - LONGER + 1)])
    hexes = F.array_join(F.transform(_chars(value), lambda c, i: F.when(c == ":", c).otherwise(F.substr(F.lit("0123456789abcdef"), F.pmod(_at(stream, i), F.lit(16)) + 1, F.lit(1)))), "")
    prefix = F.regexp_extract(value, "^(?:AKIA|gh[pousr]_|sk-)", 0)
    secret = F.concat(F.when(prefix != "", F.concat(prefix, _alike(F.substr(value, F.length(prefix) + 1), stream))).otherwise(hexes), extra)
    digits = F.concat(_alike(value, stream), extra)
    card = F.concat(F.left(value, F.lit(1)), F.substr(digits, F.lit(2)))
    body = F.left(card, F.length(card) - 1)
    luhn = F.when(_luhn_sum(value) % 10 == 0, F.concat(body, F.pmod(10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string"))).otherwise(card)
    country = F.left(value, F.lit(1))
    # check digits of an IBAN that had right ones
    account, state = F.substr(digits, F.lit(5)), F.left(value, F.lit(2))
    right = _mod97(F.concat(F.substr(value, F.lit(5)), F.left(value, F.lit(4)))) == 1
    iban = F.concat(state, F.when(right, F.lpad((98 - _mod97(F.concat(account, state, F.lit("00")))).cast("string"), 2, "0")).otherwise(F.substr(digits, F.lit(3), F.lit(2))), account)
    head = F.split(value, r"\|")

    def name(script: Column, n: int, end: Column) -> Column:
        out = F.lit(None).cast("string")
        for s, syl in _SYLLABLES.items():
            pool = F.array(*map(F.lit, syl))
            made = F.concat(*[F.get(pool, F.pmod(_at(stream, F.lit(3 + j)), F.lit(len(syl)))) for j in range(n + draw // 4)], end)
            out = F.when(script == s, made).otherwise(out)
        return out

    end = F.lit(None).cast("string")
    for (g, s), ends in _ENDS.items():
        end = F.when((F.get(head, F.lit(0)) == g) & (F.get(head, F.lit(1)) == s), F.get(F.array(*map(F.lit, ends)), F.pmod(_at(stream, F.lit(0)), F.lit(len(ends))))).otherwise(end)
    given = F.concat_ws("|", F.get(head, F.lit(0)), F.get(head, F.lit(1)), name(F.get(head, F.lit(1)), 1, end))
    family = F.concat_ws("|", F.get(head, F.lit(0)), name(F.get(head, F.lit(0)), 3, F.lit("")))
    return (
        F.when(kind == "email", email)
        .when(kind == "ipv4", F.concat_ws(".", *octets) if draw < LONGER else address)
        .when(kind == "ipv6", hexes if draw < LONGER else address)
        .when(kind == "secret", secret)
        .when(kind == "card", luhn)
        .when(kind == "phone", F.concat(country, F.substr(digits, F.lit(2))))
        .when(kind == "iban", iban)
        .when(kind == "given", given)
        .when(kind == "family", family)
        .otherwise(digits)
    )


def written(e: Column, kind: Column, value: Column) -> Column:
    """The canonical surrogate `value` written as the entity `e` was."""
    walked = F.aggregate(
        _chars(e),
        F.struct(F.lit(0).alias("i"), F.lit("").alias("out")),
        lambda a, c: F.when(c.rlike("[0-9A-Z]"), F.struct((a["i"] + 1).alias("i"), F.concat(a["out"], F.substr(value, a["i"] + 1, F.lit(1))).alias("out"))).otherwise(F.struct(a["i"].alias("i"), F.concat(a["out"], c).alias("out"))),
        lambda a: F.concat(a["out"], F.substr(value, a["i"] + 1)),
    )
    upper = (e == F.upper(e)) & kind.isin("email", "ipv6", "secret")
    named = F.concat(F.regexp_extract(e, r"^\S+ ", 0), _cased(_name_words(e), value))
    return F.when(kind == "person", named).when(kind.isin("ssn", "phone", "card", "iban"), walked).when(upper, F.upper(value)).otherwise(value)


def _cased(words: Column, value: Column) -> Column:
    """The surrogate of a name, each word in the case of the mention's."""
    new = F.split(F.substring_index(value, "|", -1), " ")
    return F.array_join(F.zip_with(words, new, lambda w, v: F.when((F.length(w) > 1) & (w == F.upper(w)), F.upper(v)).otherwise(F.initcap(v))), " ")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, value, surrogate: distinct surrogates, none of them an entity of the corpus.

    It ends: the entities to be served only get fewer, while from the draw `LONGER` on (4 for names and mail) surrogates
    grow by a sign or a syllable at the latest every fourth draw, so there are at least ten times as many; addresses turn into 2^128.
    """
    shuffled = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entities = cut(entities.select("kind", "value").distinct())
    rest, served = entities, []
    for draw in count():
        # few bytes but much work: dealt out again, and the streams are columns, computed once for a row
        dealt = rest.repartition(shuffled, "kind", "value")
        seeds = dealt.select("kind", "value", _hexes(key, F.concat_ws("|", "kind", "value", F.lit(draw))).alias("h"), _hexes(key, F.concat_ws("|", F.lit("domain"), F.substring_index("value", "@", -1))).alias("d"))
        streams = seeds.select("kind", "value", _stream(F.col("h")).alias("h"), _stream(F.col("d")).alias("d"))
        free = streams.select("kind", "value", surrogate(F.col("kind"), F.col("value"), F.col("h"), F.col("d"), draw).alias("surrogate"))
        for taken in [entities.select("kind", F.col("value").alias("surrogate"))] + [d.select("kind", "surrogate") for d in served]:
            free = free.join(taken, ["kind", "surrogate"], "left_anti")
        first = cut(free.groupBy("kind", "surrogate").agg(F.min("value").alias("value")).select("kind", "value", "surrogate"))
        served.append(first)
        rest = cut(rest.join(first, ["kind", "value"], "left_anti"))
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, served)


def _standing_for(mentions: DataFrame, key: str) -> DataFrame:
    """kind, value, surrogate of all that is mentioned; a person's surrogate is those of its words."""
    named = mentions.kind == "person"
    people = cut(resolved(cut(mentions.where(named).select("value").distinct())))
    part = people.select("value", F.posexplode(_parts(F.col("gender"), F.split("name", " "))).alias("i", "p")).select(F.col("value").alias("person"), "i", "p.kind", "p.value")
    table = surrogates(mentions.where(~named).select("kind", "value").unionByName(part.select("kind", "value")), key)
    words = F.transform(F.array_sort(F.collect_list(F.struct("i", F.substring_index("surrogate", "|", -1).alias("w")))), lambda x: x["w"])
    whole = part.join(table, ["kind", "value"]).groupBy("person").agg(F.array_join(words, " ").alias("surrogate"))
    return table.unionByName(whole.select(F.lit("person").alias("kind"), F.col("person").alias("value"), "surrogate"))


def replace(docs: DataFrame, text: str = "text", key: str = KEY, report: bool = True) -> DataFrame:
    """docs with every entity of `text` replaced; with `report`, columns n_entities and entity_kinds follow.

    entity_kinds: sorted, distinct, joined by commas; names without a title count as well.  A null text stays null and has none; rows
    without entities (empty texts, too) stay as they are, repeated rows get the same text, and
    null or repeated keys don't matter.  Texts are read whole, however long; an empty table gives
    no rows.  Where patterns overlap, the first in the text counts, of those at one place the first
    kind of `PATTERNS`; of names without a title the longest.  With `report`, columns of those names that docs already has are replaced.
    """
    kept = [c for c in docs.columns if not report or c not in ("n_entities", "entity_kinds")]
    others = F.struct(F.lit(0).alias("__0"), *[F.col(c) for c in kept if c != text]).alias("__row")
    rows = docs.select(others, F.col(text).alias("__t"))
    whole = F.coalesce(F.col("__t"), F.lit(""))
    some = whole.rlike(HINT)
    plain = rows.where(~some | ~whole.rlike(PATTERN))
    hashed = F.unhex(F.sha2("__t", 256)).alias("__h")
    # rows with entities are stored with what they mention, so the pattern runs twice over other texts and once more here
    found = F.transform(F.regexp_extract_all("__t", F.lit(PATTERN), F.lit(0)), lambda e: F.struct(e.alias("e"), kind_of(e).alias("kind")))
    texts = rows.where(some & whole.rlike(PATTERN)).select("__row", "__t", found.alias("__e"))
    texts = cut(texts.select("__row", "__t", F.transform("__e", lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), mention(x["e"], x["kind"]).alias("m"))).alias("__e"), hashed))

    # titled names; full ones are looked for in all texts
    titled = texts.select("__h", F.explode(F.array_distinct(F.filter("__e", lambda x: x["kind"] == "person"))).alias("x"))
    spelled = F.array_join(_name_words(F.col("x.e")), " ")
    sure = ~F.rtrim(_title(F.col("x.e")), F.lit(".")).isin(_UNSURE)
    titled = titled.select("__h", spelled.alias("old"), sure.alias("sure"), F.col("x.m.of").alias("kind"), F.col("x.m.value").alias("value"))
    full = titled.where("kind = 'person'")
    known = cut(full.where("sure").select(F.substring_index("value", "|", -1).alias("name")).distinct())
    names = full.select("__h", "old", F.lit(0).alias("rank"), "kind", "value")
    people = titled.where("sure").select("__h", "old")
    if not known.isEmpty():
        looked = plain.where(F.col("__t").rlike(RUN)).select(hashed, "__t").unionByName(texts.select("__h", "__t"))
        runs = looked.select("__h", F.explode(_runs(F.col("__t"))).alias("old"))
        hits = cut(runs.join(_bounded(known, F.octet_length("name")), F.lower("old") == F.col("name")).select("__h", "old").distinct())
        # untitled names make their texts part of the work; if these are few, their hashes go out, else the texts meet them by hash
        marks = cut(hits.select("__h", F.lit(True).alias("__hit")).distinct())
        sized = _bounded(marks, F.lit(32))
        flagged = plain.select("__row", "__t", hashed).join(sized, "__h", "left")
        flagged = flagged if sized is not marks else cut(flagged)
        named = cut(flagged.where("__hit").select("__row", "__t", F.filter(F.array(F.lit(None).cast(texts.schema["__e"].dataType.elementType)), lambda x: x.isNotNull()).alias("__e"), "__h"))
        plain, texts = flagged.where("__hit is null").select("__row", "__t"), texts.unionByName(named)
        names = names.unionByName(hits.select("__h", "old", F.lit(1).alias("rank"), F.lit("person").alias("kind"), F.concat(F.lit("n|"), F.lower("old")).alias("value")))
        people = people.unionByName(hits)
    last = F.substring_index("old", " ", -1)
    names = names.unionByName(people.select("__h", last.alias("old"), F.lit(2).alias("rank"), F.lit("family").alias("kind"), _family(last).alias("value")))
    names = names.groupBy("__h", "old").agg(F.min(F.struct("rank", "kind", "value")).alias("m")).select("__h", "old", "m.kind", "m.value")

    # what each text mentions, titled or not; then what stands for it
    said = F.array_distinct(F.transform("__e", lambda x: x["m"]))
    mentions = texts.select("__h", F.explode(said).alias("m")).distinct().select("__h", F.lit(None).cast("string").alias("old"), F.col("m.of").alias("kind"), "m.value")
    mentions = cut(mentions.unionByName(names))
    label = lambda kind, value: F.concat_ws(":", kind, value)
    by_label = F.collect_list(F.when(F.col("old").isNull(), F.struct(label("kind", "value").alias("k"), F.col("surrogate").alias("v"))))
    by_name = F.collect_list(F.when(F.col("old").isNotNull(), F.struct((-F.length("old")).alias("n"), F.col("old").alias("k"), _cased(F.split("old", " "), F.col("surrogate")).alias("v"))))
    maps = mentions.join(_standing_for(mentions, key), ["kind", "value"]).groupBy("__h").agg(F.map_from_entries(by_label).alias("__m"), F.array_sort(by_name).alias("__names"))
    joined = texts.join(maps.withColumnRenamed("__h", "__h2"), F.col("__h") == F.col("__h2"))
    new = F.transform("__e", lambda x: written(x["e"], x["kind"], F.element_at(F.col("__m"), label(x["m"]["of"], x["m"]["value"]))))
    # names stand between the entities; the longest first
    either = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?<!\p{L}[\-'’])(?=\p{Lu})(?:"), F.array_join(F.transform("__names", lambda x: F.concat(F.lit(r"\Q"), x["k"], F.lit(r"\E"))), "|"), F.lit(r")(?![\p{L}\p{N}]|[\-'’]\p{Lu})"))
    joined = joined.select("__row", "__e", new.alias("__new"), F.split("__t", PATTERN, -1).alias("__p"), F.when(F.size("__names") > 0, either).alias("__either"), F.map_from_entries(F.transform("__names", lambda x: F.struct(x["k"], x["v"]))).alias("__m"))
    joined = joined.withColumn("__q", F.when(F.col("__either").isNotNull(), F.transform("__p", lambda p: F.regexp_extract_all(p, F.col("__either"), F.lit(0)))))
    woven = lambda parts, between: F.array_join(F.zip_with(parts, between, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    piece = F.zip_with("__p", "__q", lambda p, q: woven(F.split(p, F.col("__either"), -1), F.transform(q, lambda x: F.element_at(F.col("__m"), x))))
    n_names = F.coalesce(F.size(F.flatten("__q")), F.lit(0))
    kinds = F.concat(F.transform("__e", lambda x: x["kind"]), F.when(F.col("__either").isNotNull() & (n_names > 0), F.array(F.lit("person"))).otherwise(F.array().cast("array<string>")))
    changed = joined.select(
        "__row",
        woven(F.when(F.col("__either").isNotNull(), piece).otherwise(F.col("__p")), F.col("__new")).alias("__t"),
        (F.size("__e") + F.when(F.col("__either").isNotNull(), n_names).otherwise(0)).cast("long").alias("n_entities"),
        F.array_join(F.array_sort(F.array_distinct(kinds)), ",").alias("entity_kinds"),
    )
    untouched = plain.select("__row", "__t", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("entity_kinds"))
    both = untouched.unionByName(changed)
    return both.select(*[F.col("__t").alias(c) if c == text else F.col("__row")[c].alias(c) for c in kept], *(["n_entities", "entity_kinds"] if report else []))


def key_of(spark: SparkSession) -> str:
    """The key that the session names; the built-in one, which anybody can read, is told of on a cluster."""
    named = spark.conf.get(KEY_SETTING, None)
    if not named and not spark.sparkContext.master.startswith("local"):
        warnings.warn(f"{KEY_SETTING} is not set: surrogates are made with a key that is public")
    return named or KEY


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key=key_of(spark))


QUERIES = {"op7_pii": op7_pii}
