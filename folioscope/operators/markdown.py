"""Blocks and images of a Markdown text with their places in it, in one forward pass.

Lines go through the open containers (quotes and list items), then to the open leaf or a new one.
Leaves that can hold assets are kept with the places of their lines: HTML blocks, pipe tables, and
texts (paragraphs and headings).  Code keeps nothing.  Link definitions are taken from the heads of
paragraphs.  Images of a text are found by a stack of brackets, so each character is met a bounded
number of times, whatever is left unclosed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

#: Containers within each other; what goes deeper is text.
DEEPEST = 100
#: Elements that begin an HTML block wherever they stand (fixed values, CommonMark).
BLOCK_NAMES = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p "
    "param search section summary table tbody td tfoot th thead title tr track ul"
)
#: Elements whose content is no markup (fixed values).
RAW_NAMES = "pre script style textarea"

_LINE = re.compile(r"\r\n|\r|\n")
_ATTRIBUTE = r"""\s++[A-Za-z_:][\w.:-]*+(?:\s*+=\s*+(?:[^\s"'=<>`]++|'[^']*+'|"[^"]*+"))?+"""
_OPEN_TAG = rf"<[A-Za-z][A-Za-z0-9-]*+(?:{_ATTRIBUTE})*+\s*+/?>"
_CLOSE_TAG = r"</[A-Za-z][A-Za-z0-9-]*+\s*+>"
_TAG = re.compile(f"{_OPEN_TAG}|{_CLOSE_TAG}")
_ALONE = re.compile(rf"(?:{_OPEN_TAG}|{_CLOSE_TAG})[ \t]*$")
_RAW_START = re.compile(rf"<(?:{RAW_NAMES.replace(' ', '|')})(?=[\s>]|$)", re.I)
_RAW_END = re.compile(rf"</(?:{RAW_NAMES.replace(' ', '|')})>", re.I)
_NAMED = re.compile(rf"</?(?:{BLOCK_NAMES.replace(' ', '|')})(?=\s|/?>|$)", re.I)
_DECLARED = re.compile("<![A-Za-z]")
_HEADING = re.compile(r"#{1,6}(?=[ \t]|$)")
_FENCE = re.compile(r"(`{3,})[^`]*$|(~{3,})")
_RULE = re.compile(r"(?:(?:-[ \t]*){3,}|(?:_[ \t]*){3,}|(?:\*[ \t]*){3,})$")
_UNDERLINE = re.compile(r"(?:=+|-+)[ \t]*$")
_BULLET = re.compile(r"[-+*](?=[ \t]|$)|(\d{1,9})[.)](?=[ \t]|$)")
_COLUMNS = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_TITLE = r"""(?:"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'|\((?:[^()\\]|\\.)*+\))"""
_DEFINITION = re.compile(rf"[ ]{{0,3}}\[((?:[^\[\]\\]|\\.){{1,999}})\]:[ \t]*\n?[ \t]*(<(?:[^<>\n\\]|\\.)*+>|(?!<)\S++)(?:(?:[ \t]+|[ \t]*\n[ \t]*){_TITLE})?[ \t]*(?:\n|$)", re.S)
_SPECIAL = re.compile(r"[\\`<\[\]!]")
_TICKS = re.compile("`+")
_AUTOLINK = re.compile(r"<(?:[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+)>")
_REFERENCE = re.compile(r"\[((?:[^\[\]\\]|\\.){0,999})\]", re.S)
_GAP = re.compile(r"[ \t\n]*")
_PATH_RUN = re.compile(r"[^\\()\x00-\x20\x7f]*")
_LINK_TITLE = re.compile(_TITLE, re.S)
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
_MARKUP = re.compile(r"(\*{1,3}|_{1,3})(?=\S)(.+?)(?<=\S)\1", re.S)


def decoded(value: str) -> str:
    """Character references that end in a semicolon are resolved."""
    return _ENTITY.sub(lambda m: unescape(m[0]), value) if "&" in value else value


def unescaped(value: str) -> str:
    """Also without the backslashes before punctuation."""
    return decoded(_ESCAPE.sub(lambda m: "&amp;" if m[1] == "&" else m[1], value))


@dataclass
class Leaf:
    """kind: html, table or text; the places of its lines' contents, without prefixes of containers."""

    kind: str
    lines: list[tuple[int, int]]
    columns: int = 0

    @property
    def start(self) -> int:
        return self.lines[0][0]

    @property
    def end(self) -> int:
        return self.lines[-1][1]


@dataclass
class _Item:
    """A container: a quote (indent -1), or a list item whose content begins after so many columns."""

    indent: int
    bare: bool = False


@dataclass
class Blocks:
    """The leaves of a text in order, and its link definitions."""

    text: str
    leaves: list[Leaf] = field(default_factory=list)
    links: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.stack: list[_Item] = []
        self.leaf: Leaf | None = None  # an open paragraph, table or HTML block
        self.fence: str | None = None
        self.html_end: re.Pattern | str | None = None
        at = 1 if self.text[:1] == "﻿" else 0
        for m in _LINE.finditer(self.text):
            if m.start() >= at:
                self._line(at, m.start())
                at = m.end()
        self._line(at, len(self.text))
        self._close()

    # places in a line: where, in which column, and columns of a tab that are not used up
    def _indent(self, pos: int, col: int, rest: int, end: int) -> tuple[int, int]:
        """First place that is no white space, and the columns before it."""
        width = rest
        while pos < end and self.text[pos] in " \t":
            step = 4 - col % 4 if self.text[pos] == "\t" else 1
            pos, col, width = pos + 1, col + step, width + step
        return pos, width

    def _advance(self, pos: int, col: int, rest: int, n: int, end: int) -> tuple[int, int, int]:
        while n:
            if rest:
                used = min(rest, n)
                rest, n = rest - used, n - used
            elif pos < end and self.text[pos] in " \t":
                rest = 4 - col % 4 if self.text[pos] == "\t" else 1
                pos, col = pos + 1, col + rest
            else:
                break
        return pos, col, rest

    def _close(self) -> None:
        leaf, self.leaf, self.fence, self.html_end = self.leaf, None, None, None
        if leaf is not None and (leaf.kind != "text" or self._definitions(leaf)):
            self.leaves.append(leaf)

    def _definitions(self, leaf: Leaf) -> bool:
        """Takes link definitions from the head of a paragraph; whether anything is left of it."""
        if self.text[leaf.start] != "[":
            return True
        joined, at = Joined(self.text, leaf.lines), 0
        while (m := _DEFINITION.match(joined.text, at)) and m.end() > at:
            label = label_of(m[1])
            if label:
                angle = m[2].startswith("<")
                self.links.setdefault(label, unescaped(m[2][1:-1] if angle else m[2]))
            at = m.end()
        if at:
            gone = joined.text.count("\n", 0, at) if at < len(joined.text) else len(leaf.lines)
            leaf.lines = leaf.lines[gone:]
        return bool(leaf.lines)

    def _line(self, a: int, b: int) -> None:
        text, stack = self.text, self.stack
        pos, col, rest, k = a, 0, 0, 0
        while k < len(stack):
            p, width = self._indent(pos, col, rest, b)
            if stack[k].indent < 0:
                if width > 3 or p >= b or text[p] != ">":
                    break
                pos, col, rest = p + 1, col + (width - rest) + 1, 0
                pos, col, rest = self._advance(pos, col, rest, 1, b)
            elif p >= b:
                if stack[k].bare:
                    break
            elif width >= stack[k].indent:
                pos, col, rest = self._advance(pos, col, rest, stack[k].indent, b)
                stack[k].bare = False
            else:
                break
            k += 1
        if k < len(stack) and (self.leaf is None or self.leaf.kind != "text"):
            self._close()
            del stack[k:]
        if self.fence is not None:
            p, width = self._indent(pos, col, rest, b)
            m = _TICKS.match(text, p, b) if self.fence[0] == "`" else re.compile("~+").match(text, p, b)
            if width < 4 and m and m.end() - p >= len(self.fence) and not text[m.end() : b].strip():
                self.fence = None
            return
        if self.leaf is not None and self.leaf.kind == "html":
            p, _ = self._indent(pos, col, rest, b)
            if self.html_end is None and p >= b:
                self._close()
            else:
                self.leaf.lines.append((pos, b))
                if self.html_end is not None and self._ends(p, b):
                    self._close()
                return
        self._blocks(pos, col, rest, b, k)

    def _ends(self, p: int, b: int) -> bool:
        end = self.html_end
        return self.text.find(end, p, b) >= 0 if isinstance(end, str) else end.search(self.text, p, b) is not None

    def _blocks(self, pos: int, col: int, rest: int, b: int, k: int) -> None:
        """Begins the blocks of what is left of a line, of whose containers k go on."""
        text, stack = self.text, self.stack

        def new() -> None:
            self._close()
            del stack[k:]

        while True:
            p, width = self._indent(pos, col, rest, b)
            open_text = self.leaf is not None and self.leaf.kind == "text"
            if p >= b:
                new()
                return
            if width >= 4:
                if open_text:
                    self.leaf.lines.append((p, b))
                else:
                    new()
                return
            ch = text[p]
            if ch == ">" and len(stack) < DEEPEST:
                new()
                pos, col, rest = self._advance(p + 1, col + (width - rest) + 1, 0, 1, b)
                stack.append(_Item(-1))
                k = len(stack)
                continue
            if ch == "#" and (m := _HEADING.match(text, p, b)):
                new()
                at, _ = self._indent(m.end(), 0, 0, b)
                if at < b:
                    self.leaves.append(Leaf("text", [(at, b)]))
                return
            if ch in "`~" and (m := _FENCE.match(text, p, b)):
                new()
                self.fence = m[1] or m[2]
                return
            if ch == "<" and self._html(p, b, open_text):
                end = self.html_end
                new()
                self.leaf, self.html_end = Leaf("html", [(p, b)]), end
                if end is not None and self._ends(p + 1, b):
                    self._close()
                return
            if open_text and k == len(stack):
                if ch in "|-:" and (n := self._columns(p, b)):
                    head = self.leaf.lines.pop()
                    if self.leaf.lines:
                        self._close()
                    self.leaf = Leaf("table", [head, (p, b)], n)
                    return
                if ch in "=-" and _UNDERLINE.match(text, p, b):
                    self._close()
                    return
            if ch in "-_*" and _RULE.match(text, p, b):
                new()
                return
            if len(stack) < DEEPEST and (m := _BULLET.match(text, p, b)):
                after, gap = self._indent(m.end(), col + (width - rest) + m.end() - p, 0, b)
                if not (open_text and k == len(stack) and (after >= b or m[1] not in (None, "1"))):
                    new()
                    pad = 1 if after >= b or gap > 4 else gap
                    pos, col, rest = self._advance(m.end(), col + (width - rest) + m.end() - p, 0, pad, b)
                    stack.append(_Item(width + m.end() - p + pad, after >= b))
                    k = len(stack)
                    continue
            if open_text:  # also where containers end: a lazy line
                self.leaf.lines.append((p, b))
            elif self.leaf is not None and self.leaf.kind == "table":
                self.leaf.lines.append((p, b))
            else:
                new()
                self.leaf = Leaf("text", [(p, b)])
            return

    def _html(self, p: int, b: int, open_text: bool) -> bool:
        """Whether an HTML block begins here; sets what ends it (nothing: a blank line)."""
        text = self.text
        self.html_end = None
        if _RAW_START.match(text, p, b):
            self.html_end = _RAW_END
        elif text.startswith("<!--", p):
            self.html_end = "-->"
        elif text.startswith("<?", p):
            self.html_end = "?>"
        elif text.startswith("<![CDATA[", p):
            self.html_end = "]]>"
        elif _DECLARED.match(text, p, b):
            self.html_end = ">"
        else:
            return _NAMED.match(text, p, b) is not None or not open_text and _ALONE.match(text, p, b) is not None
        return True

    def _columns(self, p: int, b: int) -> int:
        """Columns of a table whose second row stands here and whose first is the open paragraph's last line."""
        a, e = self.leaf.lines[-1]
        if self.text.find("|", a, e) < 0 or self.text[p : p + 2] in ("- ", "-\t") or not _COLUMNS.match(self.text, p, b):
            return 0
        n = len(cells(self.text, a, e))
        return n if n == len(cells(self.text, p, b)) else 0


class Joined:
    """Contents of lines, joined by line feeds, and where a place in them is in the source."""

    def __init__(self, text: str, spans: list[tuple[int, int]], glue: str = "\n") -> None:
        self.spans = spans
        self.text = glue.join(text[a:b] for a, b in spans)
        self.first, at = [], 0
        for a, b in spans:
            self.first.append(at)
            at += b - a + len(glue)

    def source(self, at: int) -> int:
        if len(self.spans) == 1:
            return self.spans[0][0] + at
        k = max(0, bisect_right(self.first, at) - 1)
        return min(self.spans[k][0] + at - self.first[k], self.spans[k][1])

    def source_end(self, at: int) -> int:
        """The place after the one before `at`."""
        return self.source(at - 1) + 1 if at else self.source(0)


def cells(text: str, a: int, b: int) -> list[list[tuple[int, int]]]:
    """The cells of a table row as pieces of the source: a backslash before a bar is left out."""
    while a < b and text[a] in " \t":
        a += 1
    while b > a and text[b - 1] in " \t":
        b -= 1
    out: list[list[tuple[int, int]]] = [[]]
    at = a
    bar = text.find("|", a, b)
    while bar >= 0:
        if bar > a and text[bar - 1] == "\\":
            out[-1].append((at, bar - 1))
            at = bar
        else:
            out[-1].append((at, bar))
            out.append([])
            at = bar + 1
        bar = text.find("|", bar + 1, b)
    out[-1].append((at, b))
    blank = lambda cell: all(x == y for x, y in cell)
    if len(out) > 1 and blank(out[0]):
        out.pop(0)
    if len(out) > 1 and blank(out[-1]):
        out.pop()
    return [_trimmed(text, cell) for cell in out]


def _trimmed(text: str, cell: list[tuple[int, int]]) -> list[tuple[int, int]]:
    cell = [s for s in cell if s[0] < s[1]]
    while cell and not text[cell[0][0] : cell[0][1]].strip():
        cell.pop(0)
    while cell and not text[cell[-1][0] : cell[-1][1]].strip():
        cell.pop()
    if cell:
        a, b = cell[0]
        cell[0] = (b - len(text[a:b].lstrip()), b)
        a, b = cell[-1]
        cell[-1] = (a, a + len(text[a:b].rstrip()))
    return cell


def label_of(label: str) -> str:
    return " ".join(label.split()).casefold()


@dataclass
class Found:
    """An image in a text: its place, its path and where that stands (None for a reference), its alt (None: none given)."""

    start: int
    end: int
    path: str
    path_start: int | None
    path_end: int | None
    alt: str | None


def images(s: str, links: dict[str, str]) -> list[Found]:
    """The images of a text that no other image holds, in order; those in code, comments or tags are none."""
    found: list[Found] = []
    stack: list[list] = []  # [place of the bracket, whether it opens an image, whether a link may end there, images found before]
    never: set[str] = set()
    ticks: dict[int, list[int]] | None = None
    pos = 0

    def closer(mark: str, at: int) -> int:
        if mark in never:
            return -1
        end = s.find(mark, at)
        if end < 0:
            never.add(mark)
        return end

    while m := _SPECIAL.search(s, pos):
        at, ch = m.start(), m[0]
        pos = at + 1
        if ch == "\\":
            pos = at + 2
        elif ch == "`":
            run = _TICKS.match(s, at).end() - at
            if ticks is None:
                ticks = {}
                for t in _TICKS.finditer(s):
                    ticks.setdefault(t.end() - t.start(), []).append(t.start())
            same = ticks[run] if run in ticks else []
            k = bisect_right(same, at)
            pos = same[k] + run if k < len(same) else at + run
        elif ch == "<":
            if m := _AUTOLINK.match(s, at) or _TAG.match(s, at):
                if s[at : at + 4].lower() == "<img" and s[at + 4] in " \t\n/>" and (one := element_image(s, at, m.end())):
                    found.append(one)
                pos = m.end()
            else:
                for opening, mark in (("<!--", "-->"), ("<?", "?>"), ("<![CDATA[", "]]>"), ("<!", ">")):
                    if s.startswith(opening, at):
                        end = closer(mark, at + len(opening))
                        pos = end + len(mark) if end >= 0 else pos
                        break
        elif ch == "!":
            if s.startswith("[", pos):
                stack.append([at, True, True, len(found)])
                pos += 1
        elif ch == "[":
            stack.append([at, False, True, len(found)])
        elif stack:
            start, image, live, before = stack.pop()
            tail = _tail(s, start + 1 + image, at, links) if live else None
            if tail is None:
                continue
            path, path_start, path_end, pos = tail
            if image:
                del found[before:]
                found.append(Found(start, pos, path, path_start, path_end, _plain(s[start + 2 : at])))
            else:  # no link within a link
                for x in stack:
                    if not x[1]:
                        x[2] = False
    return found


def _tail(s: str, start: int, end: int, links: dict[str, str]) -> tuple[str, int | None, int | None, int] | None:
    """What follows a bracket that ends a label: path, its place, and where the link ends."""
    if s.startswith("(", end + 1):
        at = _GAP.match(s, end + 2).end()
        if not s.startswith("<", at):
            span = _raw_path(s, at)
        else:
            close = s.find(">", at)
            inner = s[at + 1 : close] if close > 0 else "<"
            span = (at + 1, close, close + 1) if not re.search(r"[<\n]", inner) else None
        if span:
            a, b, at = span
            gap = at if s.startswith(")", at) else _GAP.match(s, at).end()
            if gap > at and (t := _LINK_TITLE.match(s, gap)):
                gap = _GAP.match(s, t.end()).end()
            if s.startswith(")", gap):
                return unescaped(s[a:b]), (a if a < b else None), (b if a < b else None), gap + 1
    if (m := _REFERENCE.match(s, end + 1)) and (key := label_of(m[1] or s[start:end])) in links:
        return links[key], None, None, m.end()
    if not (m and m[1]) and (key := label_of(s[start : min(end, start + 1000)])) in links:
        return links[key], None, None, m.end() if m else end + 1
    return None


def _raw_path(s: str, at: int) -> tuple[int, int, int] | None:
    depth, p = 0, at
    while True:
        p = _PATH_RUN.match(s, p).end()
        if p >= len(s):
            break
        c = s[p]
        if c == "\\" and p + 1 < len(s) and s[p + 1] not in " \t\n":
            p += 1
        elif c <= " " or c == "\x7f":
            break
        elif c == "(":
            depth += 1
            if depth > 32:
                return None
        elif c == ")":
            if not depth:
                break
            depth -= 1
        p += 1
    return (at, p, p) if not depth else None


def _plain(label: str) -> str:
    """A label's text: of images and links within only theirs, without emphasis and escapes."""
    for _ in range(3 if "[" in label else 0):
        label, n = re.subn(r"!?\[([^\[\]]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)", r"\1", label)
        if not n:
            break
    return unescaped(_MARKUP.sub(r"\2", label)) if any(c in label for c in "*_\\&") else label


_NAME = re.compile(r"""[\s/]*([^\s"'>/=]+)(\s*=\s*)?""")
_VALUE = re.compile(r"""[^\s"'=<>`]*""")


def attribute_spans(tag: str) -> dict[str, tuple[int, int]]:
    """Where the value of each attribute stands in a tag; the first of a name counts.

    A quote that isn't closed reaches to the end; a quote elsewhere is passed over.
    """
    out: dict[str, tuple[int, int]] = {}
    at = m.end() if (m := re.match(r"<[^\s/>]*", tag)) else 0
    while at < len(tag):
        m = _NAME.match(tag, at)
        if m is None:
            if tag[at] == ">":
                break
            at += 1
            continue
        at = m.end()
        a = b = m.end(1)
        if m[2]:
            if tag[at : at + 1] in ("'", '"'):
                close = tag.find(tag[at], at + 1)
                a, b = at + 1, close if close >= 0 else len(tag)
                at = b + 1
            else:
                a, b = at, _VALUE.match(tag, at).end()
                at = b
        out.setdefault(m[1].lower(), (a, b))
    return out


def element_image(s: str, a: int, b: int) -> Found | None:
    """The image of an img element; None without a source."""
    spans = attribute_spans(s[a:b])
    if "src" not in spans:
        return None
    value = {k: decoded(s[a + x : a + y]) for k, (x, y) in spans.items() if k in ("src", "alt")}
    x, y = spans["src"]
    return Found(a, b, value["src"], a + x, a + y, value.get("alt"))


_ELEMENT = re.compile(r"<(/?)(img|table|pre|script|style|textarea)(?=[\s/>]|$)", re.I)
_INSIDE = re.compile(r"[^<>\"']*")


def elements(text: str, a: int, b: int) -> Iterator[tuple[str, bool, int, int]]:
    """(name, closing, start, end) of the img and table tags of an HTML block, outside comments and raw elements."""
    pos = a
    while (at := text.find("<", pos, b)) >= 0:
        pos = at + 1
        if text.startswith("<!--", at):
            end = text.find("-->", at + 4, b)
            pos = end + 3 if end >= 0 else b
            continue
        m = _ELEMENT.match(text, at, b)
        if m is None or m[1] and m[2].lower() not in ("img", "table"):
            continue
        name, p = m[2].lower(), m.end()
        while p < b:
            p = _INSIDE.match(text, p, b).end()
            if p < b and text[p] in "\"'":
                close = text.find(text[p], p + 1, b)
                p = close + 1 if close >= 0 else b
            else:
                break
        whole = p < b and text[p] == ">"
        if name in ("img", "table"):
            if whole and not (name == "img" and m[1]):
                yield name, bool(m[1]), at, p + 1
            pos = p + 1 if whole else p
        elif whole or p >= b:
            close = re.compile(rf"</{name}\s*>", re.I).search(text, p, b)
            pos = close.end() if close else b
        else:
            pos = p
