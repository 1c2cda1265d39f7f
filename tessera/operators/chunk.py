"""Markdown text to parent and child chunks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Chunking
from ..functions.text import strip, uuid5

FENCE = "```"
_HEADING = re.compile(r"(#{1,6})\s+(.*)")
_TITLED = re.compile(r"(?m)^(#{1,6})\s+\S")
#: Sentence ends: after a full-width or closing mark, or after a Western mark before white space.  Fixed value.
_SENTENCE_END = re.compile(r"(?<=[。！？；!?;．])|(?<=[.!?;])(?=\s)")
#: Documents whose chunks a worker holds at a time.
_DOCUMENTS = 500
_PARENT = pa.schema([("source", pa.string()), ("parent_index", pa.int32()), ("heading", pa.string()), ("parent_text", pa.string()), ("char_len", pa.int32()), ("parent_id", pa.string())])


def markdown_blocks(text: str) -> list[tuple[str, str]]:
    """(breadcrumb, block) pairs.  A fenced block is one block, literally; a heading names what follows it; a blank line ends a block."""
    found: list[tuple[str, str]] = []
    trail: list[tuple[int, str]] = []
    open_lines: list[str] = []
    fenced = False

    def close() -> None:
        if open_lines:
            found.append((" > ".join(title for _, title in trail), "\n".join(open_lines).strip()))
            open_lines.clear()

    for line in text.splitlines():
        toggles = line.lstrip().startswith(FENCE)
        if toggles and not fenced:
            close()
        if toggles or fenced:
            open_lines.append(line)
            if toggles:
                if fenced:
                    close()
                fenced = not fenced
        elif heading := _HEADING.match(line):
            close()
            level = len(heading[1])
            trail = [*((n, t) for n, t in trail if n < level), (level, heading[2].strip())]
        elif line.strip():
            open_lines.append(line)
        else:
            close()
    close()
    return found


def split_block(block: str, size: int) -> list[str]:
    """Pieces of at most ``size`` characters: sentences packed greedily, longer ones cut; stripped, empty ones dropped."""
    if len(block) <= size:
        pieces = [block]
    else:
        packed = [""]
        for sentence in _SENTENCE_END.split(block):
            if len(packed[-1]) + len(sentence) <= size or not packed[-1]:
                packed[-1] += sentence
            else:
                packed.append(sentence)
        pieces = [p[i : i + size] for p in packed for i in range(0, len(p), size)]
    return [p for p in map(str.strip, pieces) if p]


def split_text(text: str, label: str, max_parent: int) -> Iterator[tuple[str, str]]:
    """(heading, parent text) of each parent chunk of a document.

    The label is the root of the breadcrumbs, unless the text has a top-level heading of its own.
    """
    levels = [len(h) for h in _TITLED.findall(text)]
    rooted = bool(label) and min(levels, default=9) > 1
    for heading, block in markdown_blocks(text):
        path = (f"{label} > {heading}" if rooted else heading) if heading else label
        prefix = f"[{path}] " if path else ""
        for piece in split_block(block, max(1, max_parent - len(prefix))):
            yield path, prefix + piece


def parents(docs: DataFrame, source: str = "source", text: str = "text", label: str | None = None, params: Chunking | None = None) -> DataFrame:
    """One row per parent chunk: parent_id, parent_text, source, heading, parent_index, char_len.

    One Arrow pass without a shuffle: a document's chunks come from its own row.  (The same as a fold of
    Column expressions took five times as long: folds over arrays are interpreted.)
    """
    most = (params or Chunking()).max_parent
    named = docs.select(F.col(source).cast("string").alias("source"), F.col(text).alias("text"), (F.col(label).cast("string") if label else F.lit("")).alias("label"))

    def run(batches):
        for batch in (b.slice(i, _DOCUMENTS) for b in batches for i in range(0, b.num_rows, _DOCUMENTS)):
            out = [[] for _ in _PARENT]
            for name, t, lab in zip(*(batch.column(c).to_pylist() for c in ("source", "text", "label")), strict=True):
                for i, (heading, said) in enumerate(split_text(t or "", lab or "", most)):
                    for column, value in zip(out, (name, i, heading, said, len(said), str(uuid.uuid5(uuid.NAMESPACE_URL, "::".join(x for x in (name, str(i), said) if x is not None)))), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PARENT, strict=True)], schema=_PARENT)

    return named.mapInArrow(run, "source string, parent_index int, heading string, parent_text string, char_len int, parent_id string")


def child_spans(length: Column, params: Chunking) -> Column:
    """Array of (start, end) windows; a short last one joins the one before it if that stays within the tolerance."""
    step, size = params.max_child - params.overlap, params.max_child
    n = F.greatest(F.ceil((length - size) / step), F.lit(0)).cast("int")
    spans = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct((i * step).alias("s"), F.least(i * step + size, length).alias("e")))
    last, before = F.element_at(spans, -1), F.get(spans, F.size(spans) - 2)
    merges = (F.size(spans) > 1) & (last["e"] - last["s"] < params.min_child) & (last["e"] - before["s"] <= int(size * params.merge_ratio))
    merged = F.concat(F.slice(spans, 1, F.size(spans) - 2), F.array(F.struct(before["s"].alias("s"), last["e"].alias("e"))))
    return F.when(length <= 0, F.array().cast("array<struct<s:int,e:int>>")).when(merges, merged).otherwise(spans)


def children(parent_rows: DataFrame, params: Chunking | None = None) -> DataFrame:
    """One row per child chunk: child_id, parent_id, child_text, child_index, char_start, char_end, source, parent_index."""
    params = params or Chunking()
    rows = parent_rows.select("parent_id", "source", "parent_index", "parent_text", F.posexplode(child_spans(F.col("char_len"), params)).alias("child_index", "_s"))
    cut = strip(F.substr("parent_text", F.col("_s.s") + 1, F.col("_s.e") - F.col("_s.s")))
    rows = rows.select("parent_id", "source", "parent_index", "child_index", F.col("_s.s").alias("char_start"), F.col("_s.e").alias("char_end"), cut.alias("child_text"))
    return rows.filter(F.length("child_text") > 0).withColumn("child_id", uuid5(F.concat_ws("::", "parent_id", "child_index", "child_text")))
