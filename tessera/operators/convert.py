"""Text and HTML documents to Markdown."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterable
from html.entities import html5
from html.parser import HTMLParser
from itertools import groupby
from operator import itemgetter
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import HINTS, KINDS
from ..functions.text import strip, suffix

def _two(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# -- decoding --------------------------------------------------------------------------------------------


def decode_bytes(data: bytes) -> tuple[str, str]:
    """Text and encoding: a byte order mark, UTF-8, GB18030, or UTF-8 with replacements."""
    if data.startswith(b"\xef\xbb\xbf"):
        return data.decode("utf-8-sig", "replace"), "utf-8-sig"
    for name in ("utf-8", "gb18030"):
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace"), "utf-8-replace"


@F.arrow_udf(_two("text", "encoding"))
def decode_text(contents: pa.Array) -> pa.Array:
    rows = [None if c is None else dict(zip(("text", "encoding"), decode_bytes(c), strict=True)) for c in contents.to_pylist()]
    return pa.array(rows, pa.struct([("text", pa.string()), ("encoding", pa.string())]))


# -- plain text --------------------------------------------------------------------------------------------

#: Numbered headings.  Fixed values.
HEADINGS = [
    r"^第[一二三四五六七八九十百零\d]+[章节篇部分]\s*[、:：.．]?\s*\S",
    r"^[（(][一二三四五六七八九十\d]+[)）]\s*\S",
    r"^\d+(\.\d+){1,3}\s*[、:：.．]?\s*\S",
    r"^[一二三四五六七八九十]+[、.．]\s*\S",
    r"^[IVXLC]+[.、]\s*\S",
    r"^附\s*录\s*[A-Z\d一二三四五六七八九十]*\s*$",
]
#: Characters that end a sentence, not a heading.  Fixed value.
SENTENCE_TAIL = "。！？；…!?;:：\"'）)》】」』"
#: List items.  Fixed value.
LIST_ITEM = r"^\s*(?:[-*+•·]|\d+[.)、](?!\d)\s*|[（(]\d+[)）]\s*)"


_HEADINGS = [re.compile(p) for p in HEADINGS]
_LIST_ITEM = re.compile(LIST_ITEM)


def is_heading(line: str, before_blank: bool) -> bool:
    """Whether a line is a heading: no sentence end, no list item, before a blank line, and at most 20 characters, or numbered and at most 60."""
    t = line.strip()
    if not 0 < len(t) <= 60 or not before_blank or t[-1] in SENTENCE_TAIL or _LIST_ITEM.match(t):
        return False
    return len(t) <= 20 or any(p.match(t) for p in _HEADINGS)


def in_one_line(lines: Iterable[str]) -> str:
    """Stripped, not empty lines in one, with a blank only between two ASCII characters."""
    out: list[str] = []
    for line in lines:
        if out and out[-1][-1].isascii() and line[0].isascii():
            out.append(" ")
        out.append(line)
    return "".join(out)


def text_blocks(text: str) -> list[tuple[str, str]]:
    """(kind, block) pairs of a plain text: heading, paragraph or list.

    A run of ordinary lines is one paragraph; a blank line, a heading and a list item end it.
    One pass over the lines, whatever their number.
    """
    lines = text.splitlines()
    bare = [line.strip() for line in lines]
    before_blank = [not b for b in bare[1:]] + [False] * bool(bare)
    kinds = ["" if not b else "heading" if is_heading(b, e) else "list" if _LIST_ITEM.match(line) else "paragraph" for line, b, e in zip(lines, bare, before_blank, strict=True)]
    out: list[tuple[str, str]] = []
    for kind, run in groupby(zip(kinds, bare, strict=True), key=itemgetter(0)):
        said = [b for _, b in run]
        if kind == "paragraph":
            out.append((kind, in_one_line(said)))
        elif kind:
            out += [(kind, b) for b in said]
    return out


@F.arrow_udf(T.ArrayType(_two("kind", "block")))
def reflow(texts: pa.Array) -> pa.Array:
    """Array of (kind, block) of each text."""
    rows = [None if t is None else [{"kind": k, "block": b} for k, b in text_blocks(t)] for t in texts.to_pylist()]
    return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("block", pa.string())])))


@F.arrow_udf(T.StringType())
def _text_markdown(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else "\n\n".join(f"## {b}" if k == "heading" else b for k, b in text_blocks(t)) for t in texts.to_pylist()], pa.string())


def text_to_markdown(text: Column) -> Column:
    """Headings become ``## x``; blocks are separated by blank lines."""
    return normalise(_text_markdown(text))


def normalise(markdown: Column) -> Column:
    """Stripped, with one final line end; empty stays empty."""
    t = strip(markdown)
    return F.when(F.length(t) > 0, F.concat(t, F.lit("\n"))).otherwise(F.lit(""))


# -- HTML ------------------------------------------------------------------------------------------------------

#: Elements whose text is noise, and elements that end a line.  Fixed values.
NOISE = ("script", "style", "nav", "header", "footer", "aside", "noscript")
LINE_ELEMENTS = "p|div|br|li|tr|h[1-6]|section|article|ul|ol|dl|dt|dd|table|blockquote|pre"
_HEADS = ("h1", "h2", "h3", "h4", "h5", "h6")
_SEMANTIC = (*_HEADS, "p", "li", "pre")
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")


_REFERENCE = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+)|[0-9A-Za-z]+);|&")


@F.arrow_udf(T.StringType())
def unescape(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html.unescape(t) if "&" in t else t for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def whole_references(texts: pa.Array) -> pa.Array:
    """Pages in which each ``&`` that begins no known reference up to its semicolon, as in ``&amp</p>``, is escaped, so that it stays as it is."""
    one = lambda m: m[0] if m[0].startswith("&#") or m[0][1:] in html5 else f"&amp;{m[0][1:]}"
    return pa.array([None if t is None else _REFERENCE.sub(one, t) if "&" in t else t for t in texts.to_pylist()], pa.string())


def strip_tags(page: Column) -> Column:
    """Plain text of a page: noise out, block tags to line ends, other tags to blanks, entities resolved, blanks folded.

    References that lack their semicolon are resolved as browsers do; ``whole_references`` of the page leaves them.
    """
    t = F.regexp_replace(page, rf"(?is)<({'|'.join(NOISE)})\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, rf"(?i)</?(?:{LINE_ELEMENTS})\b[^>]*>", "\n")
    t = unescape(F.regexp_replace(t, "<[^>]+>", " "))
    # the three foldings of blanks are fixed values
    t = F.regexp_replace(t, r"[ \t\r\f\x0b]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, " *\n *", "\n"), "\n{3,}", "\n\n")
    return strip(t)


class _Blocks(HTMLParser):
    """Collects the outermost semantic blocks of a page, without noise elements.

    Open elements lie on a stack.  An end tag closes the latest open element of its name and all that
    were opened in it; one without an open element says nothing; the end of the page closes all.  So
    the text of an element that is never closed, such as ``<p>`` or ``<li>`` before the next one, is kept in the
    block that it stands in.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.noise, self.block = None, None  # places on the stack of the outermost noise element and semantic block
        self.found: list[tuple[str, list[str], str]] = []
        self.texts: list[str] = []
        self.langs: dict[str, str] = {}

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        self.open.append(tag)
        at = len(self.open) - 1
        if self.noise is not None:
            return
        if tag in NOISE:
            self.noise = at
        elif tag in _SEMANTIC and self.block is None:
            self.block, self.texts, self.langs = at, [], {}
        if self.block is not None and self.open[self.block] == "pre" and tag in ("pre", "code") and tag not in self.langs:
            named = re.search(r"(?:^|\s)(?:language|lang|highlight)-(\S+)", dict(attrs).get("class") or "")
            self.langs[tag] = named[1] if named else ""

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def _close(self, place: int) -> None:
        """Closes the elements from ``place`` on the stack on."""
        if self.block is not None and self.block >= place:
            self.found.append((self.open[self.block], self.texts, self.langs.get("code") or self.langs.get("pre", "")))
            self.block = None
        if self.noise is not None and self.noise >= place:
            self.noise = None
        del self.open[place:]

    def handle_endtag(self, tag):
        for place in range(len(self.open) - 1, -1, -1):
            if self.open[place] == tag:
                self._close(place)
                return

    def handle_data(self, data):
        if self.block is not None and self.noise is None:
            self.texts.append(data)

    def close(self):
        super().close()
        self._close(0)


def page_to_markdown(page: str) -> str:
    """Structured conversion: headings one level down, paragraphs, list items and fenced code."""
    parser = _Blocks()
    parser.feed(page)
    parser.close()
    out = []
    for name, texts, lang in parser.found:
        if name == "pre":
            code = "".join(texts).replace("\r\n", "\n").replace("\r", "\n")
            if code.strip():
                fence = "````" if "```" in code else "```"
                out.append(f"{fence}{lang}\n{code.strip(chr(10))}\n{fence}")
            continue
        line = ""
        for piece in (" ".join(t.split()) for t in texts):
            if piece:
                line += (" " if line and line[-1].isascii() and piece[0].isascii() else "") + piece
        if line:
            out.append("#" * min(int(name[1]) + 1, 6) + f" {line}" if name in _HEADS else f"- {line}" if name == "li" else line)
    joined = "\n\n".join(out).strip()
    return f"{joined}\n" if joined else ""


@F.arrow_udf(T.StringType())
def html_to_markdown(pages: pa.Array) -> pa.Array:
    return pa.array([None if p is None else page_to_markdown(p) for p in pages.to_pylist()], pa.string())


# -- DOCX ------------------------------------------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_to_markdown(data: bytes) -> str:
    """Paragraphs and tables of a document's body in order; heading styles one level down, list styles as items."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    out: list[str] = []
    for e in root.find(f"{_W}body"):
        if e.tag == f"{_W}p" and (text := said(e)):
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            outline = e.find(f"{_W}pPr/{_W}outlineLvl")
            head = re.search(r"(?:heading|标题)\s*([1-9])", name, re.I)
            level = int(head[1]) if head else int(outline.get(f"{_W}val")) + 1 if outline is not None else 0
            listed = re.search(r"list\s*(?:bullet|number|paragraph)|列表|项目符号", name, re.I) or e.find(f"{_W}pPr/{_W}numPr") is not None
            out.append(f"{'#' * min(level + 1, 6)} {text}" if level else f"- {text}" if listed else text)
        elif e.tag == f"{_W}tbl":
            rows = [[said(c).replace("|", "\\|") for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]
            rows = [r for r in rows if any(r)]
            if rows:
                width = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                out.append("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))
    joined = "\n\n".join(out).strip()
    return f"{joined}\n" if joined else ""


@F.arrow_udf(_two("markdown", "error"))
def convert_docx(contents: pa.Array) -> pa.Array:
    def one(data: bytes | None) -> dict:
        try:
            return {"markdown": docx_to_markdown(data or b""), "error": None}
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, TypeError) as e:
            return {"markdown": "", "error": f"{type(e).__name__}: {e}"}

    return pa.array([one(c) for c in contents.to_pylist()], pa.struct([("markdown", pa.string()), ("error", pa.string())]))


# -- dispatch ---------------------------------------------------------------------------------------------------


def kind_of(path: Column) -> Column:
    """Kind by suffix; null if unknown."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), suffix(path))


def capability(path: Column, structured_html: bool = True) -> Column:
    """(indexable, reason) by suffix alone."""
    k = kind_of(path)
    ok = k.isin("markdown", "text", "html", "docx")
    reason = F.when(k.isNull(), "unsupported").when(k.isin("pdf", "doc"), "not_implemented").when((k == "html") & F.lit(not structured_html), "degraded")
    return F.struct(F.coalesce(ok, F.lit(False)).alias("indexable"), reason.alias("reason"))


def hint(reason: Column) -> Column:
    """What a user can do about a reason; null for none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in HINTS.items() for x in pair]), reason)


def convert(files: DataFrame, structured_html: bool = True) -> DataFrame:
    """Files (``path, content``) with kind, markdown, available, reason and warnings."""
    rows = files.withColumn("kind", kind_of(F.col("path"))).withColumn("_d", decode_text(F.when(F.col("kind").isin("markdown", "text", "html"), F.col("content"))))
    rows = rows.withColumn("_x", convert_docx(F.when(F.col("kind") == "docx", F.col("content"))))
    text = F.regexp_replace(F.col("_d.text"), "^﻿+", "")
    page = html_to_markdown(F.when(F.col("kind") == "html", text)) if structured_html else normalise(strip_tags(text))
    markdown = F.when(F.col("kind") == "markdown", text).when(F.col("kind") == "text", text_to_markdown(text)).when(F.col("kind") == "html", page).when((F.col("kind") == "docx") & F.col("_x.error").isNull(), F.col("_x.markdown"))
    reason = capability(F.col("path"), structured_html)["reason"]
    rows = rows.withColumn("markdown", F.coalesce(markdown, F.lit(""))).withColumn("reason", F.when((F.col("kind") == "docx") & F.col("_x.error").isNotNull(), "parse_error").otherwise(reason))
    available = F.col("kind").isin("markdown", "text", "html", "docx") & ~F.coalesce(F.col("reason") == "parse_error", F.lit(False))
    empty = F.when(available & (F.length(strip(F.col("markdown"))) == 0), F.lit("empty"))
    return rows.withColumn("available", F.coalesce(available, F.lit(False))).withColumn("encoding", F.col("_d.encoding")).withColumn("warnings", F.array_compact(F.array(empty, F.col("_x.error")))).drop("_d", "_x")
