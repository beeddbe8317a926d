"""HTML extraction: the main text of web pages by differencing pages of near URLs.

Within each host, pages stand in the order of their URL paths, and each is paired with the
neighbour with which it shares the longest path prefix.  All text lines of both are aligned by
their longest common subsequence, and lines that the pair shares are deleted: menus, notices,
adverts and the like, whether their markup tells or not.

Markup helps where lines alone can't decide.  Lines of an article or main element are kept though
copies of the article share them, and what navigation, footers, forms, comments, ... hold goes
though no other page has it.  But an article element isn't taken at its word: if the page's own
lines outside it are longer (a teaser in an article, the story in a plain element), both count.

Pairing sorts the host's pages over all partitions and joins on places, so a host may have any
number of pages; pages with equal markup count once, at their least path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import cut
from .url_filter import host_and_path

#: Elements whose content is no text.
_SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "head", "title", "select", "option", "button", "textarea", "math", "audio", "video", "map", "datalist"}
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
_CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
_MAIN = {"article", "main"}
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul head".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Class, id and role words that mark what is no article.
_CHROME_WORDS = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menubar|header|masthead|footer|sidebar|side|aside|ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|banner|cookie|cookies|consent|gdpr|notice|alert|popup|modal|overlay|subscribe|newsletter|signup|login|share|sharing|social|related|recommended|breadcrumb|breadcrumbs|comment|comments|commentlist|disqus|replies|reply|widget|pagination|pager|search|toolbar|skip|contentinfo|complementary|form)(?=$|[\s_-])"
)
#: Inside an article only whole names count, as its parts are often called "related-work" or "side-effects", and these parts of names:
#: readers' comments and adverts under any name, and what says that it is a box of links, buttons or adverts.
_BOXES = "(?:area|articles|banner|bar|block|box|button|buttons|container|content|icons|items|label|links|list|news|pages|panel|posts|products|section|slot|stories|tools|unit|widget|wrapper)"
_CHROME_NAMES = re.compile(
    _CHROME_WORDS.pattern.replace(r"[\s_-]", r"\s")
    + r"|(?:^|[\s_-])(?:comment|comments|commentlist|disqus|advert|adverts|advertisement|sponsored|newsletter|breadcrumb|breadcrumbs)(?=$|[\s_-])"
    + rf"|(?:^|[\s_-])(?:ad|ads|promo|related|recommended|share|sharing|social|subscribe|cookie|consent)[_-](?:share|sharing|{_BOXES})(?=$|[\s_-])"
)
#: Attributes as HTML has them: a quote opens a string right after the equals sign only.
_ATTRIBUTES = r"""(?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?+|=)*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_ATTRIBUTES})(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s/>=]+)\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>"'][^\s>]*))""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")

OPEN, MAIN, CHROME = 0, 1, 2
#: Inside an article or main element whose chrome is only a class or the like on an ancestor.
WRAPPED = 3
#: What isn't shown, whatever it holds.
HIDDEN = 4


def _marks_chrome(name: str, attrs: str, in_article: bool) -> bool:
    if not attrs or name in ("html", "body"):
        return False
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if key in ("class", "id", "role", "aria-label") and (_CHROME_NAMES if in_article else _CHROME_WORDS).search(value.lower()):
            return True
    return False


def _hides(name: str, attrs: str) -> bool:
    if not attrs or name in ("html", "body") and "=" in attrs:
        return False
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if key == "style" and _HIDDEN.search(value) or key == "aria-hidden" and value.lower() == "true":
            return True
    return re.search(r"(?:^|\s)hidden(?=[\s/]|$)(?!\s*=)", attrs) is not None


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(zone, text) of every non-empty block in page order.

    A block ends where a block element begins or ends; a line break is white space in it.
    Character references are decoded, white space becomes one space.
    """
    if not html:
        return []
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int, bool]] = []  # name, zone, silent
    zone, silent, text = OPEN, False, []

    def end() -> None:
        nonlocal text
        if text:
            line = _SPACE.sub(" ", unescape("".join(text))).strip()
            if line:
                out.append((zone, line))
            text = []

    at, size = 0, len(html)
    open_count: dict[str, int] = {}
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            lt = size
        if lt > at and not silent:
            text.append(html[at:lt])
        if lt == size:
            break
        m = _TOKEN.match(html, lt)
        if not m:  # a lone < is text
            if not silent:
                text.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA[") and not silent:
                text.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name = name.lower()
        if not m[1]:
            if name in _BLOCK:
                end()
                if name == "p" and open_count.get("p"):  # an open paragraph ends here
                    while stack and stack[-1][0] not in _BLOCK - {"p"}:
                        gone = stack.pop()
                        open_count[gone[0]] -= 1
                        if gone[0] == "p":
                            break
                    zone, silent = (stack[-1][1], stack[-1][2]) if stack else (OPEN, False)
            elif name == "br":
                if not silent:
                    text.append(" ")
            if name in _VOID or m[3].endswith("/") and name not in _BLOCK and name not in _RAW:
                continue
            inside = MAIN if zone == OPEN and (name in _MAIN or re.search(r"role\s*=\s*[\"']?main", m[3])) else zone
            # a header inside an article may hold its title
            if zone == CHROME and name in _MAIN and not any(open_count.get(c) for c in _CHROME):
                inside = WRAPPED
            if name in _CHROME and not (name == "header" and zone in (MAIN, WRAPPED)) or _marks_chrome(name, m[3], zone in (MAIN, WRAPPED) or name in _MAIN):
                inside = CHROME
            if zone == HIDDEN or _hides(name, m[3]):
                inside = HIDDEN
            quiet = silent or name in _SILENT
            if inside != zone and text:
                end()
            stack.append((name, inside, quiet))
            open_count[name] = open_count.get(name, 0) + 1
            zone, silent = inside, quiet
            if name in _RAW:
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                at = close.start() if close else size
        elif open_count.get(name):
            if name in _BLOCK or any(s[1] != zone for s in stack[-1:]):
                end()
            # what was left open inside ends too; only a block's end closes blocks
            if name in _BLOCK or name in _SILENT:
                while stack:
                    gone = stack.pop()
                    open_count[gone[0]] -= 1
                    if gone[0] == name:
                        break
            else:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        zone_changes = stack[i][1] != (stack[i - 1][1] if i else OPEN)
                        if zone_changes:
                            end()
                        inner = stack[i + 1 :]
                        del stack[i:]
                        open_count[name] -= 1
                        below = stack[-1][1] if stack else OPEN
                        for s in inner:
                            stack.append((s[0], s[1] if not zone_changes else below, s[2]))
                        break
                    if stack[i][0] in _BLOCK:
                        break
            new_zone, new_silent = (stack[-1][1], stack[-1][2]) if stack else (OPEN, False)
            if new_zone != zone:
                end()
            zone, silent = new_zone, new_silent
        elif name in _BLOCK:
            end()
            if name == "p":
                continue
    end()
    return out


def common(a: list[int], b: list[int], most: int = 1 << 28) -> np.ndarray:
    """Which of a's lines lie in a longest common subsequence of a and b.

    Bit-parallel: a row of the table of lengths is one integer, whose zeros are the places in b
    where the length grows.  Rows are kept for the way back; where that takes more than `most`
    bits, a is halved at the best place of b first.
    """
    keep = np.zeros(len(a), dtype=bool)
    low, tail, top = 0, 0, min(len(a), len(b))
    while low < top and a[low] == b[low]:
        low += 1
    while tail < top - low and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    keep[:low] = keep[len(a) - tail :] = True
    x, y = a[low : len(a) - tail], b[low : len(b) - tail]
    if not x or not y:
        return keep
    if len(x) > 1 and len(x) * len(y) > most:
        half = len(x) // 2
        ahead, back = _lengths(x[:half], y), _lengths(x[half:][::-1], y[::-1])[::-1]
        at = int(np.argmax(ahead + back))
        keep[low : len(a) - tail] = np.concatenate([common(x[:half], y[:at], most), common(x[half:], y[at:], most)])
        return keep
    rows = _rows(x, y)
    j = len(y)
    i = len(x)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            keep[low + i] = True
    return keep


def _steps(a: list[int], b: list[int]) -> Iterator[int]:
    where: dict[int, int] = {}
    for j, v in enumerate(b):
        where[v] = where.get(v, 0) | 1 << j
    every = row = (1 << len(b)) - 1
    yield row
    for v in a:
        hit = row & where.get(v, 0)
        row = (row + hit | row - hit) & every
        yield row


def _rows(a: list[int], b: list[int]) -> list[int]:
    return list(_steps(a, b))


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a and each beginning of b."""
    last = 0
    for last in _steps(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(last.to_bytes(-(-len(b) // 8), "little"), dtype=np.uint8), bitorder="little", count=len(b))
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _hash(line: str) -> int:
    from hashlib import blake2b

    return int.from_bytes(blake2b(line.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def line_hashes(found: list[tuple[int, str]]) -> list[int]:
    """The lines of a page that others are compared with: all that are shown."""
    return [_hash(t) for z, t in found if z != HIDDEN]


def decided(found: list[tuple[int, str]]) -> bool:
    """Whether no partner can change the main text: an article is as long as all that is outside it."""
    size = lambda zone: sum(len(t) for z, t in found if z == zone)
    return size(OPEN) == 0 or 0 < size(MAIN) >= size(OPEN)


def main_text(found: list[tuple[int, str]], partner: list[int] | None) -> list[str]:
    """Blocks of the main text; partner: line hashes of the paired page."""
    shown = [(z, t) for z, t in found if z != HIDDEN]
    shared = common([_hash(t) for _, t in shown], partner) if partner is not None and not decided(found) else np.zeros(len(shown), dtype=bool)
    own = {i for i, (z, _) in enumerate(shown) if z == OPEN and not shared[i]}
    article = {i for i, (z, _) in enumerate(shown) if z == MAIN}
    length = lambda places: sum(len(shown[i][1]) for i in places)
    if not article:
        wrapped = {i for i, (z, _) in enumerate(shown) if z == WRAPPED}
        article = wrapped if length(wrapped) > length(own) else set()
        places = article or own
    else:
        places = article | own if length(own) > length(article) else article
    return [shown[i][1] for i in sorted(places)]


def partners(pages: DataFrame) -> DataFrame:
    """host, x, px: for each page of a host the page of the nearest URL path; pages: host, segs, x.

    x stands for a page's markup.  Of a page's two neighbours in the host's order of paths the one
    with more leading segments in common is nearest, of equally near ones the one before.
    """
    spark = pages.sparkSession
    spots = pages.groupBy("host", "x").agg(F.min("segs").alias("segs"))
    ordered = spots.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "host", "segs", "x").sortWithinPartitions("host", "segs", "x")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part), pa.int32()), pa.array(np.arange(at, at + b.num_rows), pa.int64())], names=[*b.schema.names, "part", "at"])
            at += b.num_rows

    placed = cut(ordered.mapInArrow(number, "host string, x bigint, segs array<string>, part int, at bigint"))
    # a row for each partition
    sizes = sorted(tuple(r) for r in placed.groupBy("part").count().collect())
    starts = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    before = spark.createDataFrame([(p, starts[i]) for i, (p, _) in enumerate(sizes)], "part int, start bigint")
    me = placed.join(F.broadcast(before), "part").select("host", "x", "segs", (F.col("start") + F.col("at")).alias("g"))
    there = lambda step: me.select((F.col("g") + step).alias("g"), F.col("host").alias("o_host"), F.col("x").alias("px"), F.col("segs").alias("o_segs"), F.lit(step).alias("step"))
    near = me.join(there(1).union(there(-1)), "g").where("host = o_host")
    same = F.zip_with("segs", "o_segs", lambda p, q: F.coalesce(p == q, F.lit(False)))
    prefix = F.when(F.forall(same, lambda z: z), F.size(same)).otherwise(F.array_position(same, False) - 1)
    return near.groupBy("host", "x").agg(F.max_by("px", F.struct(prefix.alias("n"), F.col("step").alias("step"))).alias("px"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars: one row for each row of pages.

    text: the blocks of the main text joined by two line feeds; empty for null or empty html and
    pages without text, and where a page without an article element has no line of its own.  A
    null url, one without a host or a host's only page pairs with nothing: nothing is deleted
    there.  Ties of partners are broken by order.  Null and repeated keys and repeated rows are
    kept (equal pages have equal texts); other columns are ignored, whatever their names; pages
    are read whole, however long; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("u"))
    source = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).alias("h"))
    source = source.select("k", "u", "h", F.when((host != "") & F.col("h").isNotNull(), host).alias("host"), F.split(path, "/").alias("segs"), F.xxhash64("h").alias("x"))
    hosted = source.where("host is not null")
    nearest = partners(hosted.select("host", "segs", "x"))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [line_hashes(blocks(h)) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.list_(pa.int64()))], names=["host", "px", "lines"])

    each = hosted.select("host", "x", "h").mapInArrow(lines, "host string, px bigint, lines array<bigint>")
    told = nearest.join(each.groupBy("host", "px").agg(F.any_value("lines").alias("lines")), ["host", "px"]).select("host", "x", "lines")

    # what markup alone decides goes with a key of its own, and meets no partner
    first = T.StructType([T.StructField("k", source.schema["k"].dataType), T.StructField("u", T.StringType()), T.StructField("host", T.StringType()), T.StructField("x", T.LongType()), T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("zones", T.ArrayType(T.ByteType()))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, texts, zones = batch.column(3).to_pylist(), [], []
            for i, h in enumerate(batch.column(2).to_pylist()):
                found = [(z, t) for z, t in blocks(h) if z != HIDDEN]
                if decided(found):
                    found, hosts[i] = [(MAIN, t) for t in main_text(found, None)], None
                texts.append([t for _, t in found])
                zones.append([z for z, _ in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hosts, pa.string()), batch.column(4), pa.array(texts, pa.list_(pa.string())), pa.array(zones, pa.list_(pa.int8()))], names=first.names)

    parsed = source.select("k", "u", "h", "host", "x").mapInArrow(parse, first)
    spot = F.coalesce("host", F.concat(F.lit("/"), F.xxhash64("k", "u", "x").cast("string")))
    ready = parsed.withColumn("host", spot).join(told, ["host", "x"], "left").select("k", "u", "texts", "zones", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n\n".join(main_text(list(zip(z, t, strict=True)), p)) for t, z, p in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, "url", "text", "n_chars"])

    schema = T.StructType([T.StructField(key, source.schema["k"].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return ready.mapInArrow(run, schema)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op3_html_extraction": op3_html_extraction}
