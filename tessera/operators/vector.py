"""Exact vector top-N by cosine."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_bucket, tokens
from ..sources.tables import stored
from .lexical import TOKEN_WORD

#: A batch of queries of at most this many bytes is sent to every scan task.
QUERY_BYTES = 64 << 20
#: Questions and rows that are scored at a time by the hash-vector search.
QUERIES = 256
ROWS = 1000
#: A block of scores has at most so many bytes.
SCORE_BYTES = 32 << 20
#: Scores of a block that are looked at together, so what is noted of each stays in bounds.
PIECE = 1 << 18
#: What rounding may add to a score.
ROUNDED = 1e-6
#: What single precision may add to a cosine of vectors without negative entries, for each dimension: twice what a rounding of 1 may.
ROUGH = 2.0**-23
#: Tokens whose buckets a worker remembers.
REMEMBERED = 1 << 18
#: What separates a cosine from one that is equal but for the order of its sums.
NOISE = 1e-12
ORDER = ("source", "parent_index", "child_index")


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _counts(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of buckets -> rows of counts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.bincount(np.repeat(np.arange(len(size)), size) * dim + flat, minlength=len(size) * dim).reshape(len(size), dim).astype(float)


class Buckets:
    """The buckets of texts' tokens, as ``hash_bucket`` has them."""

    def __init__(self, dim: int):
        self.dim, self.word, self.known = dim, re.compile(TOKEN_WORD), {}

    def find(self, tokens) -> dict[str, int]:
        """What is remembered, these tokens among it."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for token in tokens:
            if token not in known:
                known[token] = int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big") % self.dim
        return known

    def of(self, texts: pa.Array) -> pa.Array:
        """Lower-cased texts -> lists of buckets."""
        said = [self.word.findall(text or "") for text in texts.to_pylist()]
        known = self.find(token for tokens in said for token in tokens)
        return pa.array([[known[token] for token in tokens] for tokens in said], pa.list_(pa.int32()))


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def in_order(batch: pa.RecordBatch) -> np.ndarray:
    """The place of each row in the order of ties: source, parent, child."""
    order = np.empty(batch.num_rows, np.int64)
    order[pc.sort_indices(pa.Table.from_batches([batch.select(list(ORDER))]), [(c, "ascending") for c in ORDER]).to_numpy()] = np.arange(batch.num_rows)
    return order


class Best:
    """The n best scores of each question that a task has seen; what is below them need not leave it."""

    def __init__(self, n: int, questions: int):
        self.n, self.tops = n, np.full((n, questions), -np.inf)

    def of(self, raw: np.ndarray, least: float | None, order: np.ndarray, begin: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, questions (from ``begin`` on) and rounded scores among the n best of the block and of those before, from ``least`` on.

        A block is passed over once, for what can still get in; all else is done with that, some PIECE scores at a time.
        """
        found, rows = [], max(1, PIECE // max(1, raw.shape[1]))
        tops = self.tops[:, begin : begin + raw.shape[1]]
        for first in range(0, len(raw), rows):
            piece, low = raw[first : first + rows], tops.min(0, initial=np.inf)
            row, col = np.nonzero(piece >= (low - ROUNDED if least is None else np.maximum(low - ROUNDED, least - NOISE)))
            score = np.round(piece[row, col], 6)
            row += first
            best = np.flatnonzero(score >= low[col])
            best = best[np.lexsort((order[row[best]], -score[best], col[best]))]
            row, col, score = row[best], col[best], score[best]
            place = np.arange(len(col)) - np.searchsorted(col, col)
            keep = place < self.n
            row, col, score, place = row[keep], col[keep], score[keep], place[keep]
            asked, which = np.unique(col, return_inverse=True)
            new = np.full((self.n, len(asked)), -np.inf)
            new[place, which] = score
            tops[:, asked] = np.partition(np.concatenate([tops[:, asked], new]), self.n, axis=0)[self.n :]
            still = score >= tops.min(0, initial=np.inf)[col]
            found.append((row[still], col[still], score[still]))
        row, col, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return row, col, score


def ranked_children(found: DataFrame, n: int, qid: str, kind: str) -> DataFrame:
    """The n best of each question, in order, from what the tasks left."""
    order = Window.partitionBy("_q").orderBy(F.col("score").desc(), *ORDER)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select(F.col("_q").alias(qid), "rank", "child_id", "score", F.lit(kind).alias("score_kind"))


def top_n(vectors: DataFrame, queries: DataFrame, n: int, min_sim: float | None, key: str = "vec_id", vector: str = "embedding", qid: str = "qid", query_vector: str = "embedding") -> DataFrame:
    """``qid, rank, key, score, score_kind`` of the n most similar rows with a cosine of at least ``min_sim`` (ties to the least key).

    The queries are read in blocks of bounded size, each sent to the scan of the vectors;
    each task keeps n rows a query, so what is shuffled is n rows for each query and
    task.  The vectors themselves are never moved.
    """
    spark = vectors.sparkSession
    asked = queries.select(F.col(qid).alias("_q"), F.col(query_vector).cast("array<double>").alias("_v")).filter("_q is not null and _v is not null")
    total, width = asked.agg(F.count("*"), F.max(F.size("_v"))).first()
    blocks = max(1, -(-(total * 8 * ((width or 0) + 4)) // QUERY_BYTES))
    rows = vectors.select(F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v")).filter("_k is not null and _v is not null")
    qtype, ktype = asked.schema["_q"].dataType.simpleString(), rows.schema["_k"].dataType.simpleString()
    found = None
    for block in range(blocks):  # one pass over the vectors for each block of queries
        part = asked.filter(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == block).toArrow()
        q = _unit(_matrix(part.column("_v"))) if part.num_rows else np.zeros((0, 0))
        sent = spark.sparkContext.broadcast((part.column("_q").combine_chunks(), q))

        def run(batches, sent=sent):
            ids, q = sent.value
            best, rows_at_a_time = Best(n, len(q)), max(1, SCORE_BYTES // (8 * max(1, len(q))))
            for batch in (b.slice(i, rows_at_a_time) for b in batches for i in range(0, b.num_rows, rows_at_a_time)):
                m = _unit(_matrix(batch.column("_v")))
                d, keys = min(m.shape[1], q.shape[1]), batch.column("_k")  # what one of two has more counts as zeros
                row, col, score = best.of(m[:, :d] @ q[:, :d].T, min_sim, np.argsort(np.asarray(pc.array_sort_indices(keys))))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(col)), keys.take(pa.array(row)), pa.array(score)], ["_q", "_k", "score"])

        got = rows.mapInArrow(run, f"_q {qtype}, _k {ktype}, score double")
        found = got if found is None else found.unionByName(got)
    order = Window.partitionBy("_q").orderBy(F.col("score").desc(), "_k")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.select(F.col("_q").alias(qid), "rank", F.col("_k").alias(key), "score", F.lit("cosine").alias("score_kind"))


def hash_top_n(children: DataFrame, queries: DataFrame, n: int, min_sim: float, dim: int, qid: str = "qid", text: str = "question") -> DataFrame:
    """The vector channel on hash vectors, straight from the texts: ``qid, rank, child_id, score, score_kind``.

    A worker finds a token's bucket once and remembers it.  The questions' buckets are sent to the scan (in parts of at most QUERY_BYTES, each
    a pass over the children); a task counts its children's buckets into a small dense block, normalises, multiplies it with the
    questions, QUERIES at a time, and keeps n rows a question.  Ties go by source, parent and child order.
    """
    rows = children.select("child_id", *ORDER, F.lower("child_text").alias("_t"))

    def counted(batches):
        bucket = Buckets(dim)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            yield _counts(bucket.of(batch.column("_t")), dim), in_order(batch), batch

    return ranked_children(hash_search(rows, counted, queries, n, min_sim, dim, qid, text), n, qid, "cosine")


def hash_search(rows: DataFrame, counted: Callable, queries: DataFrame, n: int, min_sim: float, dim: int, qid: str, text: str, written: bool = False) -> DataFrame:
    """What the tasks leave of ``hash_top_n``: ``_q, child_id, source, parent_index, child_index, score``.

    Children are scored in single precision first; those that may be among the best of a question, for all that rounding can do, in double.
    ``counted`` makes of a task's batches of ``rows`` small blocks: counts by child and bucket, places in the order of ties, and the children's ids and order
    columns. ``written``: ``rows`` is a table, so several passes needn't make it again.
    """
    spark = rows.sparkSession
    buckets = lambda c: F.transform(tokens(c), lambda t: hash_bucket(t, dim))
    asked = queries.select(F.col(qid).alias("_q"), buckets(F.col(text)).alias("_b")).filter("_q is not null")
    size = asked.agg(F.sum(F.size("_b") * 4 + 16)).first()[0] or 0
    passes = max(1, -(-size // QUERY_BYTES))
    qtype = asked.schema["_q"].dataType.simpleString()
    rows = stored(rows, "children") if passes > 1 and not written else rows
    found = None
    for number in range(passes):
        part = asked.filter(F.pmod(F.xxhash64("_q"), F.lit(passes)) == number).toArrow()
        sent = spark.sparkContext.broadcast((part.column("_q").combine_chunks(), part.column("_b").combine_chunks()))

        def run(batches, sent=sent):
            ids, asked = sent.value
            best = Best(n, len(ids))
            blocks = [(i, _unit(_counts(asked.slice(i, QUERIES), dim)).T) for i in range(0, len(ids), QUERIES)] if len(ids) <= 8 * QUERIES else None
            for counts, order, keys in counted(batches):
                rough, length = counts.astype(np.float32), np.sqrt(np.einsum("ij,ij->i", counts, counts)).astype(np.float32)[:, None]
                length[length == 0] = 1
                for begin, q in blocks or ((i, _unit(_counts(asked.slice(i, QUERIES), dim)).T) for i in range(0, len(ids), QUERIES)):
                    low = best.tops[:, begin : begin + q.shape[1]].min(0, initial=np.inf)
                    floor = (low if min_sim is None else np.maximum(low, min_sim)) - (dim + 8) * ROUGH
                    near = np.flatnonzero((rough @ q.astype(np.float32) / length >= floor.astype(np.float32)).any(1))
                    if not len(near):
                        continue
                    row, col, score = best.of(_unit(counts[near]) @ q, min_sim, order[near], begin)
                    take = pa.array(near[row])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(begin + col)), *(keys.column(c).take(take) for c in ("child_id", *ORDER)), pa.array(score)], ["_q", "child_id", *ORDER, "score"])

        got = rows.mapInArrow(run, f"_q {qtype}, child_id string, source string, parent_index int, child_index int, score double")
        found = got if found is None else found.unionByName(got)
    return found
