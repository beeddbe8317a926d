"""Tables and images of Markdown documents: extraction to placeholders, restoration, hints.

Extraction takes the blocks of `markdown`: pipe tables, `<table>` elements of HTML blocks, images in
any of the three notations and `<img>` tags, outside code and comments, in time linear in the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.batches import pieces
from . import markdown as md

#: What stands for a table or an image without a description (fixed values).
NAMELESS = {"table": "표", "image": "이미지"}
_FENCE_LINE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_CELL = re.compile(r"<t[hd]\b[^>]*>(.*?)</t[hd]>", re.S | re.I)
_CELL_END = re.compile(r"</t[hd]>", re.I)


def attributes(tag: str) -> dict[str, str]:
    """Attributes of a tag; the first of a name counts, references are decoded, one without a value is empty."""
    return {name: md.decoded(tag[a:b]) for name, (a, b) in md.attribute_spans(tag).items()}


@dataclass
class _Spot:
    """A table or an image in the source; images of its cells are known beforehand for pipe tables."""

    kind: str
    start: int
    end: int
    image: md.Found | None = None
    path: tuple[int, int] | None = None
    header: str | None = None
    inner: list[_Spot] = field(default_factory=list)


def _image(one: md.Found, place: Callable[[int], int], place_end: Callable[[int], int]) -> _Spot:
    path = None if one.path_start is None else (place(one.path_start), place_end(one.path_end))
    return _Spot("image", place(one.start), place_end(one.end), one, path)


def _may_hold_image(text: str) -> bool:
    return "![" in text or "<img" in text or "<" in text and "<img" in text.lower()


def _spots(text: str) -> list[_Spot]:
    """Tables and images of all leaves; they may overlap."""
    blocks = md.Blocks(text)
    out, open_tables = [], []
    for leaf in blocks.leaves:
        if leaf.kind == "html":
            for name, closing, a, b in md.elements(text, leaf.start, leaf.end):
                if name == "img":
                    if one := md.element_image(text, a, b):
                        out.append(_image(one, int, int))
                elif not closing:
                    out.append(_Spot("table", a, leaf.end))
                    open_tables.append(out[-1])
                elif open_tables:
                    open_tables.pop().end = b
        elif leaf.kind == "text":
            joined = md.Joined(text, leaf.lines)
            if _may_hold_image(joined.text):
                out += [_image(x, joined.source, joined.source_end) for x in md.images(joined.text, blocks.links)]
        else:
            out.append(_pipe_table(text, leaf, blocks.links))
    return out


def _pipe_table(text: str, leaf: md.Leaf, links: dict[str, str]) -> _Spot:
    table = _Spot("table", leaf.start, leaf.end, header="")
    heads = []
    for r, (a, b) in enumerate(leaf.lines):
        if r == 1 or r and not _may_hold_image(text[a:b]):
            continue
        for cell in md.cells(text, a, b)[: leaf.columns]:
            joined = md.Joined(text, cell, "")
            if not r and joined.text:
                heads.append(joined.text)
            if _may_hold_image(joined.text):
                table.inner += [_image(x, joined.source, joined.source_end) for x in md.images(joined.text, links)]
    table.header = ", ".join(heads)
    return table


def _without_fences(cell: str) -> str:
    """The lines of a cell but for those that open or close a code block; the first line is never one."""
    first, *rest = cell.split("\n")
    out, fence = [first], ""
    for line in rest:
        m = _FENCE_LINE.match(line)
        if m and fence and m[1].startswith(fence) and not m[2].strip():
            fence = ""
        elif m and not fence and not (m[1][0] == "`" and "`" in m[2]):
            fence = m[1]
        else:
            out.append(line)
    return "\n".join(out)


def _without_tags(text: str) -> str:
    last = text.rfind(">") + 1
    return re.sub(r"<[^>]*>", "", text[:last]) + text[last:]


def html_header(table: str) -> str:
    """The cells of the first row of an HTML table, without tags, joined by commas."""
    low = table.lower()
    row = re.search(r"<tr\b[^>]*>", low)
    end = low.find("</tr>", row.end()) if row else -1
    if end < 0:
        return ""
    inner = table[row.end() : end]
    last = max((m.end() for m in _CELL_END.finditer(inner)), default=0)
    found = (_without_tags(_without_fences(m[1])).strip() for m in _CELL.finditer(inner[:last]))
    return ", ".join(x for x in found if x)


def _placed(spots: list[_Spot]) -> list[_Spot]:
    """Tables and images outside tables, in order and apart; images in a table are its inner ones.

    Of tables that overlap the outer one stays.  An image that reaches into a table from before it,
    or over its end, is dropped, and so is one that overlaps an image before it.
    """
    spots = sorted(spots, key=lambda s: (s.start, -s.end))
    tables: list[_Spot] = []
    for s in spots:
        if s.kind == "table":
            if tables and s.start < tables[-1].end:
                tables[-1].inner += s.inner
            else:
                tables.append(s)
    starts, free, reached = [t.start for t in tables], [], -1
    for s in spots:
        if s.kind == "table":
            continue
        k = bisect_right(starts, s.start)
        if k and s.start < tables[k - 1].end:
            if s.end <= tables[k - 1].end:
                tables[k - 1].inner.append(s)
        elif not (k < len(tables) and s.end > starts[k]) and s.start >= reached:
            free.append(s)
            reached = s.end
    for t in tables:
        t.inner.sort(key=lambda s: s.start)
    return sorted([*tables, *free], key=lambda s: s.start)


def extract(text: str, namespace: str = tx.NAMESPACE) -> tuple[str, list[dict]]:
    """Text with placeholders, and the assets in order: id, kind, markdown, path, alt, header, table_id, places.

    start and end are places in the text, path_start and path_end those of an image's path in the
    source of its table (None outside tables, for references and for paths that stand elsewhere).
    The images of a table follow it.
    """
    assets: list[dict] = []
    numbers = {"table": 0, "image": 0}
    out, last = [], 0

    def add(spot: _Spot, table: dict | None) -> dict:
        numbers[spot.kind] += 1
        one = {"id": f"{spot.kind[0]}{numbers[spot.kind]}", "kind": spot.kind, "markdown": text[spot.start : spot.end], "path": None, "alt": None, "table_id": table and table["id"]}
        one |= {"start": spot.start, "end": spot.end, "path_start": None, "path_end": None}
        if spot.kind == "table":
            label = html_header(one["markdown"]) if spot.header is None else spot.header
        else:
            alt = spot.image.alt if (spot.image.alt or "").strip() else None
            one |= {"path": spot.image.path, "alt": alt}
            label = alt or re.split(r"[/\\]", re.split("[?#]", spot.image.path)[0])[-1]
            if table and spot.path and table["start"] <= spot.path[0] <= spot.path[1] <= table["end"]:
                one |= {"path_start": spot.path[0] - table["start"], "path_end": spot.path[1] - table["start"]}
        one["header"] = _clean(label, NAMELESS[spot.kind])
        assets.append(one)
        return one

    for spot in _placed(_spots(text)):
        one = add(spot, None)
        out += [tx_guard(text[last : spot.start], namespace), f"[[{namespace}:{spot.kind}:{one['id']} | {one['header']}]]"]
        last = spot.end
        for inner in spot.inner:
            add(inner, one)
    out.append(tx_guard(text[last:], namespace))
    return "".join(out), assets


def _clean(label: str, fallback: str) -> str:
    label = re.sub(r"\s+", " ", label.replace("]]", " ")).strip().rstrip("] ")
    return label if re.search(r"[^\W_]", label) else fallback


def tx_guard(text: str, namespace: str) -> str:
    return re.sub(rf"\[(​*)\[{namespace}:", "[​\\1[" + namespace + ":", text)


ASSET = "placeholder_id string, kind string, markdown string, path string, alt string, header string, table_id string, start int, end int, path_start int, path_end int"


def extract_assets(docs: DataFrame, key: str, text: str, namespace: str = tx.NAMESPACE) -> DataFrame:
    """key, indexing_markdown, assets of each document; a null text has null Markdown and no assets.

    Line ends stay as they are.
    """
    source = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    asset = T.StructType.fromDDL(ASSET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int32()) for f in asset.fields]))
        for batch in pieces(batches, 1):
            got = [extract(t, namespace) if t is not None else (None, []) for t in batch.column(1).to_pylist()]
            rows = [[{("placeholder_id" if k == "id" else k): v for k, v in a.items()} for a in g[1]] for g in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array(rows, kind)], names=[key, "indexing_markdown", "assets"])

    return source.mapInArrow(run, T.StructType([T.StructField(key, source.schema["k"].dataType), T.StructField("indexing_markdown", T.StringType()), T.StructField("assets", T.ArrayType(asset))]))


def restore(rows: DataFrame, assets: DataFrame, key: str = "doc_id", text: str = "text", namespace: str = tx.NAMESPACE) -> DataFrame:
    """rows with the placeholders in `text` replaced by their assets' sources, in one pass.

    assets: key, placeholder_id, kind, source.  Unknown ids and other kinds stay as they are.
    """
    pattern = tx.loose_placeholder(namespace)
    maps = assets.groupBy(key).agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "kind", "placeholder_id"), "source"))).alias("__m"))
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    new = F.transform(found, lambda p: F.coalesce(F.element_at(F.col("__m"), F.concat_ws(":", F.regexp_extract(p, pattern, 1), F.regexp_extract(p, pattern, 2))), p))
    merged = F.array_join(F.zip_with(F.split(text, pattern, -1), new, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    out = rows.join(maps, key, "left")
    return out.withColumn(text, F.when(F.col("__m").isNull(), F.col(text)).otherwise(tx.unguard(merged, namespace))).drop("__m")


def rewrite_paths(tables: DataFrame, images: DataFrame) -> DataFrame:
    """tables with the paths of their images replaced by `url`.

    tables: doc_id, placeholder_id, source; images: doc_id, table_id, start, end (places in the
    source, from 0, end excluded), url.  A place that overlaps an earlier one, is empty-handed
    (start after end) or lies beyond the source is left as it is.
    """
    at = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "url")
    spots = images.where("start is not null and end is not null and url is not null")
    spots = spots.groupBy("doc_id", F.col("table_id").alias("placeholder_id")).agg(F.array_sort(F.collect_list(at)).alias("__at"))
    done = F.struct(F.lit("").alias("text"), F.lit(0).alias("next"))

    def put(s: Column, x: Column) -> Column:
        bad = (x["start"] < s["next"]) | (x["start"] > x["end"]) | (x["end"] > F.length("source"))
        piece = F.substr(F.col("source"), s["next"] + 1, x["start"] - s["next"])
        return F.when(bad, s).otherwise(F.struct(F.concat(s["text"], piece, x["url"]).alias("text"), x["end"].alias("next")))

    finish = lambda s: F.concat(s["text"], F.substr(F.col("source"), s["next"] + 1))
    out = tables.join(spots, ["doc_id", "placeholder_id"], "left")
    return out.withColumn("source", F.when(F.col("__at").isNull(), F.col("source")).otherwise(F.aggregate("__at", done, put, finish))).drop("__at")


def new_status(table_id: Column, kind: Column) -> Column:
    return F.when((kind == "image") & table_id.isNotNull(), "done").otherwise("pending")


def asset_view(rows: DataFrame) -> DataFrame:
    """Text and whether it is temporary; neither while pending."""
    pending = F.col("hint_status") == "pending"
    return rows.select("doc_id", "version", "placeholder_id", "kind", F.when(~pending, F.coalesce("hint", "description")).alias("text"), (~pending & F.col("is_temporary")).alias("is_temporary"))


def hints_for_index(rows: DataFrame) -> DataFrame:
    return rows.where("table_id is null").select("doc_id", "placeholder_id", F.coalesce("hint", "description").alias("sentence"))


def pending_hints(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where((F.col("hint_status") == "pending") & (F.col("kind") == kind) & F.col("table_id").isNull())


def inherit(rows: DataFrame, changes: DataFrame, version: str) -> DataFrame:
    """Assets of the next version; changed hints are taken over, images in tables stay untouched."""
    c = changes.select("placeholder_id", F.col("hint").alias("new_hint"))
    hit = F.col("new_hint").isNotNull() & F.col("table_id").isNull()
    out = rows.join(c, "placeholder_id", "left")
    return out.withColumns({"hint_status": F.when(hit, "done").otherwise(F.col("hint_status")), "is_temporary": F.when(hit, False).otherwise(F.col("is_temporary")), "hint": F.when(hit, F.col("new_hint")).otherwise(F.col("hint")), "version": F.lit(version)}).select(*rows.columns)


def pair_images(new: DataFrame, old: DataFrame) -> DataFrame:
    """Files stay with images of the same placeholder and path."""
    o = old.select("doc_id", "placeholder_id", "path", F.col("file_key").alias("old_key"))
    return new.join(o, ["doc_id", "placeholder_id", "path"], "left").withColumn("file_key", F.coalesce("file_key", "old_key")).drop("old_key")


def temporary_to_pending(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hint_status", F.when(F.col("is_temporary"), "pending").otherwise(F.col("hint_status")))


def first_per_path(rows: DataFrame) -> DataFrame:
    return rows.where("path is not null").groupBy("doc_id", "path").agg(F.min_by("placeholder_id", "order").alias("placeholder_id"))


def missing_assets(ids: Column, assets: Column) -> Column:
    return F.array_except(ids, assets)


def match_uploads(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """file_name, fault (duplicate_file, duplicate_metadata, no_metadata, no_file or null) by NFC name."""
    f = files.select(tx.nfc("file_name").alias("file_name")).groupBy("file_name").agg(F.count("*").alias("f"))
    m = metadata.select(tx.nfc("file_name").alias("file_name")).groupBy("file_name").agg(F.count("*").alias("m"))
    fault = F.when(F.col("f") > 1, "duplicate_file").when(F.col("m") > 1, "duplicate_metadata").when(F.col("m").isNull(), "no_metadata").when(F.col("f").isNull(), "no_file")
    return f.join(m, "file_name", "full").select("file_name", fault.alias("fault"))


def match_images(images: DataFrame, files: DataFrame) -> DataFrame:
    """Images with their file: by NFC base name, or else by the decoded one.  images: doc_id, placeholder_id, path."""
    f = files.groupBy(tx.nfc(tx.base_name(F.col("file_name"))).alias("n")).agg(F.min("file_key").alias("k"))
    a, b = f.select(F.col("n").alias("n1"), F.col("k").alias("k1")), f.select(F.col("n").alias("n2"), F.col("k").alias("k2"))
    rows = images.withColumn("b1", tx.nfc(tx.base_name(F.col("path")))).withColumn("b2", tx.nfc(F.try_url_decode(tx.base_name(F.col("path")))))
    return rows.join(a, F.col("b1") == F.col("n1"), "left").join(b, F.col("b2") == F.col("n2"), "left").select("doc_id", "placeholder_id", "path", F.coalesce("k1", "k2").alias("file_key"))
