"""Substring deduplication with an FM-index per shard.

Which words are covered by a window of ``window`` consecutive words whose sequence also
starts anywhere else in the corpus?

1. A window's minimiser is the least hash of its 12-word sequences, so equal windows have
   equal minimisers.  Each document is streamed into segments, the runs of
   windows with one minimiser; every window is in exactly one.  Only
   (minimiser, content hash, place) is kept: about one row for 12 words.
2. A minimiser that stands in a single segment, and there once, marks no repeated window.  Of the others, equal
   segments are collapsed to one with a weight, before any text moves; so a passage
   that a third of all documents share is one row.
3. The remaining distinct segments are dealt out by minimiser.  Each worker builds
   FM-indexes of at most about SHARD_WORDS words and streams its segments through them:
   backward search gives each window's number of occurrences (matching statistics, capped at the
   window's length).  A minimiser with more distinct segments than a shard holds is cut
   into several shards, its segments are streamed through each, and the counts add up.
4. Windows that occur twice or more become word intervals of their documents.

Documents are told apart by id and hash of the text, so rows need no made-up key.

Defined cases: a null text has no words; windows are judged on the input; a repeated row is
another occurrence of each of its windows; fewer words than a window: nothing is removed;
rows with a null id are documents like others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, shuffle_partitions, stored, trim
from .fm_index import FmIndex

WINDOW = 35
GRAM = 12
SHARD_WORDS = 400_000
#: Rows whose Python objects a worker holds at a time.
_ROWS = 500
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def _grams(words: list[bytes], gram: int) -> np.ndarray:
    """A hash of each run of ``gram`` words."""
    digest = xxhash.xxh3_64_intdigest
    h = np.array([digest(w) for w in words], np.uint64)
    out = h[: len(h) - gram + 1].copy()
    for k in range(1, gram):
        out = out * _BASE + h[k : len(h) - gram + 1 + k]
    out ^= out >> np.uint64(29)
    out *= _MIX
    return out ^ out >> np.uint64(32)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def segments(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimiser: first window, number of windows, minimiser, and whether the run holds it
    more than once, so that it may hold a window twice."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    grams = _grams(words, gram)
    least = _sliding_min(grams, window - gram + 1)
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    n = np.diff(np.concatenate([start, [len(least)]]))
    own = np.zeros(len(start), bool)
    ordered = np.sort(grams)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(again):
        for i in np.flatnonzero(np.isin(least[start], again)):
            own[i] = np.count_nonzero(grams[start[i] : start[i] + n[i] + window - gram] == least[start[i]]) > 1
    return start, n, least[start], own


def _streamed(window: int, gram: int):
    def run(batches):
        forget()
        for batch in (b.slice(i, _ROWS) for b in batches for i in range(0, b.num_rows, _ROWS)):
            out = [[] for _ in range(7)]
            for id_, h, text in zip(batch.column("_id").to_pylist(), batch.column("_h").to_pylist(), batch.column("_text"), strict=True):
                words = (text.as_py() or b"").split()
                start, n, least, own = segments(words, window, gram)
                if not len(start):
                    continue
                joined = b" ".join(words)
                at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
                first, last = at[start].tolist(), (at[start + n + window - 1] - 1).tolist()
                content = [xxhash.xxh3_64_intdigest(joined[a:b], 1) for a, b in zip(first, last, strict=True)]
                for column, values in zip(out, (np.full(len(start), id_), np.full(len(start), h), start, n, least.view(np.int64), np.array(content, np.uint64).view(np.int64), 1 + own), strict=True):
                    column.append(values)
            arrays = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)).cast(k) for a, k in zip(arrays, kinds, strict=True)], ["_id", "_h", "start", "n", "least", "content", "times"])
        trim()

    return run


def _fetched(window: int):
    """Documents with the segments asked of them -> those segments' words."""

    def run(batches):
        for batch in (b.slice(i, _ROWS) for b in batches for i in range(0, b.num_rows, _ROWS)):
            rows = []
            for text, asked in zip(batch.column("_text"), batch.column("asked"), strict=True):
                words = text.as_py().split()
                rows += [(a["least"], a["content"], a["weight"], a["g"], b" ".join(words[a["start"] : a["start"] + a["n"] + window - 1])) for a in asked.as_py()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["least", "content", "weight", "g", "words"])
        trim()

    return run


class Shard:
    """FM-index of some weighted texts, to count the windows of texts in."""

    def __init__(self, indexed: list[tuple[bytes, int]], window: int):
        self.window, self.ids = window, {}
        sequences = [np.fromiter((self.ids.setdefault(w, len(self.ids)) for w in text.split(b" ")), np.int64) for text, _ in indexed]
        self.index = FmIndex(sequences, np.array([w for _, w in indexed], np.int64), len(self.ids))

    def count(self, streamed: list[bytes], least: int = 2, own: bool = False) -> list[np.ndarray]:
        """For each streamed text, the (weighted) number of occurrences of each of its windows among the indexed ones.
        ``own``: the streamed texts are the indexed ones."""
        streams = [np.fromiter((self.ids.get(w, -1) for w in text.split(b" ")), np.int64) for text in streamed]
        size = np.fromiter(map(len, streams), np.int64, len(streams))
        begin = np.cumsum(size) - size
        ends = np.concatenate([np.arange(b + self.window - 1, b + s) for b, s in zip(begin, size, strict=True)])
        found = self.index.matches(np.concatenate(streams), ends, self.window, least, own)
        return np.split(found, np.cumsum(size - self.window + 1)[:-1])


def _searched(window: int, shard_words: int):
    """Rows sorted by (least, salt, whether to be indexed first, content) -> counts (0, 1, or 2 for more) of the windows of each
    segment that has any to report.

    Minimisers with few segments share shards, each searched with its own segments.  Of a crowded one (g > 1), the rows
    of a salt's own index come first; all others stream through that index, about ``shard_words`` words at a time, so a worker holds
    one index and one such part, however large the crowd is.
    """
    kind = pa.schema([("least", pa.int64()), ("content", pa.int64()), ("salt", pa.int32()), ("counts", pa.binary())])

    def reported(rows: list[tuple], found: list[np.ndarray]) -> pa.RecordBatch:
        out = [(r[0], r[1], r[4], np.minimum(c, 2).astype(np.uint8).tobytes()) for r, c in zip(rows, found, strict=True) if c.any()]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(kind)], schema=kind)

    def run(batches):
        forget()
        rows, size, last, shard = [], 0, None, None

        def done():
            """What the rows at hand report; if they are the indexed ones of a crowd, ``shard`` is made of them."""
            nonlocal shard
            texts = [r[5] for r in rows]
            if rows[0][3] == 1:
                return reported(rows, Shard([(r[5], r[2]) for r in rows], window).count(texts, 2, own=True))
            if shard is None:
                shard = Shard([(r[5], r[2]) for r in rows if r[6]], window)
            return reported(rows, shard.count(texts, 1))

        for batch in (b.slice(i, _ROWS) for b in batches for i in range(0, b.num_rows, _ROWS)):
            for row in zip(*(batch.column(n).to_pylist() for n in ("least", "content", "weight", "g", "salt", "words", "indexed")), strict=True):
                key = (row[0], row[4])
                if last is not None and key == last[:2] and row[1] == last[2]:
                    continue  # the same segment, fetched from a repeated row
                if rows:
                    crowd, other = rows[0][3] > 1, key != last[:2]
                    turns = crowd and not other and rows[-1][6] and not row[6]  # the index is complete
                    if (other and (crowd or row[3] > 1)) or turns or (size >= shard_words and (other or (crowd and not row[6]))):
                        yield done()
                        rows, size = [], 0
                if last is not None and key != last[:2]:
                    shard = None
                rows.append(row)
                size += row[5].count(b" ") + 1
                last = (*key, row[1])
        if rows:
            yield done()
        rows, shard = [], None
        trim()

    return run


def _applied(window: int):
    """Documents with their counts -> words, removed words, spans and kept text."""
    kind = pa.struct([pa.field("n_words", pa.int64()), pa.field("n_removed", pa.int64()), pa.field("spans", pa.list_(pa.struct([pa.field("start", pa.int64()), pa.field("end", pa.int64())]))), pa.field("kept", pa.string())])

    def one(text: bytes | None, found: list[dict] | None) -> dict:
        words = (text or b"").split()
        mark = np.zeros(len(words) + 1, np.int64)
        if found:
            total = np.zeros(len(words), np.int64)
            for f in found:
                counts = np.frombuffer(f["counts"], np.uint8)
                total[f["start"] : f["start"] + len(counts)] += counts
            at = np.flatnonzero(total >= 2)
            mark[at] += 1
            mark[at + window] -= 1
        gone = np.cumsum(mark)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if len(edges) else b" ".join(words)
        return {"n_words": len(words), "n_removed": int(gone.sum()), "spans": [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)], "kept": kept.decode("utf-8", "replace")}

    @F.arrow_udf("n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string")
    def udf(text: pa.Array, found: pa.Array) -> pa.Array:
        part = lambda i: pa.array([one(t.as_py(), f.as_py()) for t, f in zip(text.slice(i, _ROWS), found.slice(i, _ROWS), strict=True)], kind)
        return pa.concat_arrays([part(i) for i in range(0, len(text), _ROWS)]) if len(text) else pa.array([], kind)

    return udf


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``_row`` (the document's own columns), n_words, n_removed, ``spans`` of removed words (start, end) and ``kept`` (text)."""
    spark = docs.sparkSession
    gram = min(gram, window)
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_id"), F.xxhash64(F.col(text_col)).alias("_h")]
    named = docs.select(F.struct("*").alias("_row"), *key)
    texts = docs.select(*key, F.col(text_col).cast("binary").alias("_text"))
    all_segments = stored(texts.filter("_text is not null").mapInArrow(_streamed(window, gram), "_id long, _h long, start int, n int, least long, content long, times int"), "segments")
    shared = all_segments.groupBy("least").agg(F.sum("times").alias("m")).filter("m > 1").select("least")
    candidates = stored(all_segments.drop("times").join(shared, "least"), "candidates")
    distinct = candidates.groupBy("least", "content").agg(F.count("*").alias("weight"), F.min(F.struct("_id", "_h", "start", "n")).alias("at"))
    distinct = stored(distinct.select("least", "content", "weight", "at.*"), "distinct")
    crowd = distinct.groupBy("least").agg(F.sum(F.col("n") + (window - 1)).alias("size"))
    crowd = crowd.select("least", F.ceil(F.col("size") / shard_words).cast("int").alias("g"))
    asked = distinct.join(crowd, "least").groupBy("_id", "_h").agg(F.collect_list(F.struct("least", "content", "weight", "g", "start", "n")).alias("asked"))
    fetched = texts.join(asked, ["_id", "_h"]).select("_text", "asked").mapInArrow(_fetched(window), "least long, content long, weight long, g int, words binary")
    salts = F.explode(F.when(F.col("g") > 1, F.sequence(F.lit(0), F.col("g") - 1)).otherwise(F.array(F.lit(0))))
    dealt = fetched.withColumn("salt", salts).withColumn("indexed", F.pmod(F.col("content"), F.col("g")) == F.col("salt"))
    dealt = dealt.repartition(shuffle_partitions(spark), "least", "salt").sortWithinPartitions("least", "salt", F.desc("indexed"), "content")
    found = stored(dealt.select("least", "content", "weight", "g", "salt", "words", "indexed").mapInArrow(_searched(window, shard_words), "least long, content long, salt int, counts binary"), "found")
    of_doc = candidates.join(found, ["least", "content"]).select("_id", "_h", "start", "salt", "counts")
    of_doc = of_doc.groupBy("_id", "_h").agg(F.collect_set(F.struct("start", "salt", "counts")).alias("found"))  # a set: repeated rows report alike
    joined = named.join(of_doc, ["_id", "_h"], "left")
    return joined.select("_row", _applied(window)(F.col("_row")[text_col].cast("binary"), F.col("found")).alias("_d")).select("_row", "_d.*")


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", window: int = WINDOW) -> DataFrame:
    """The documents without their repeated windows, in their own columns.

    A text that loses nothing stays as it is; another becomes its kept words, joined by blanks, and
    ``length_col``, if there is one, its length in characters.
    """
    got = deduplicate(docs, id_col, text_col, window).select("_row", "n_removed", "kept")
    cut = F.col("n_removed") > 0
    columns = []
    for name, kind in docs.dtypes:
        old = F.col("_row")[name]
        new = F.col("kept") if name == text_col else F.length("kept").cast(kind) if name == length_col else None
        columns.append((old if new is None else F.when(cut, new).otherwise(old)).alias(name))
    return got.select(*columns)
