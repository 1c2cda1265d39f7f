"""Harmonic packing of tokenised documents into sequences.

A document's ids are cut greedily: whole sequences of CAPACITY first, then the largest
capacity // k (k up to FINEST) that fits, again and again, then one tail shorter than
capacity // FINEST.  Every piece so has a class of one exact length, and a class's bins
hold a fixed number of pieces: k of capacity // k, or capacity // length of a
tail.  Workers number their pieces within each class; a prefix sum over the small
table of counts per (class, worker) makes those numbers global, and number // k is the
bin.  No worker waits for another and no piece is moved.

Only the last, incomplete bin of each class is left over: at most k - 1 pieces a class,
a bound that holds for any input (``most_left_over``).  Those are packed by
first-fit decreasing in one task.

Defined cases: a null or empty text is the end id alone; repeated rows and null ids are
documents like others; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .word_bpe import word_bpe

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096
FINEST = 16
END_ID = 2


def classes(capacity: int = CAPACITY, finest: int = FINEST) -> list[tuple[int, int]]:
    """(piece length, pieces a bin) of each class; the place in the list is the class's number."""
    large = _large(capacity, finest)
    return [(n, capacity // n) for n in [*large, *range(large[-1] - 1, 0, -1)]]


def most_left_over(capacity: int = CAPACITY, finest: int = FINEST) -> int:
    return sum(k - 1 for _, k in classes(capacity, finest))


@lru_cache(maxsize=8)
def _large(capacity: int, finest: int) -> list[int]:
    return sorted({capacity // k for k in range(1, finest + 1)}, reverse=True)


def cut(n: int, capacity: int = CAPACITY, finest: int = FINEST) -> list[int]:
    """Piece lengths of a document of ``n`` ids, in order."""
    out = [capacity] * (n // capacity)
    n %= capacity
    for size in _large(capacity, finest):
        while n >= size:
            out.append(size)
            n -= size
    return [*out, n] if n else out


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, finest: int = FINEST, with_ids: bool = False) -> DataFrame:
    """One row per piece, with its class, the worker that made it and its number there."""
    path = path or public_tokenizers.path(TOKENIZER)
    number = {n: i for i, (n, _) in enumerate(classes(capacity, finest))}
    end = END_ID.to_bytes(4, "little")

    def run(batches):
        bpe, worker, next_of = word_bpe(path), TaskContext.get().partitionId(), [0] * len(number)
        for batch in batches:
            keep, rows, ids_of = [], [], []
            for at, ids in enumerate(bpe.encode_all(batch.column("_text").to_pylist())):
                n = len(ids) // 4 + 1
                view, start = memoryview(ids + end), 0
                for length in cut(n, capacity, finest):
                    c = number[length]
                    part = view[4 * start : 4 * (start + length)]
                    keep.append(at)
                    rows.append((start, length, zlib.crc32(part), n, c, worker, next_of[c]))
                    if with_ids:
                        ids_of.append(np.frombuffer(part, "<i4"))
                    next_of[c] += 1
                    start += length
            table = np.array(rows, np.int64).reshape(-1, 7)
            arrays = [batch.column("_id").take(pa.array(keep, pa.int64())), *(pa.array(table[:, i]) for i in range(7))]
            names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "_class", "_worker", "_number"]
            if with_ids:
                arrays.append(pa.array(ids_of, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    made = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    columns = "_id long, start long, length long, ids_crc32 long, doc_tokens long, _class long, _worker long, _number long"
    return made.mapInArrow(run, columns + ", ids array<int>" * with_ids)


def _first_fit(capacity: int, step: int):
    """Left-over pieces, all in one task, into bins; fills sequence_id and offset."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got).combine_chunks()
        length, number, cls = (table.column(n).to_numpy() for n in ("length", "_number", "_class"))
        room = np.zeros(0, np.int64)
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for i in np.lexsort((number, cls, -length)):
            fits = np.flatnonzero(room >= length[i])
            if not len(fits):
                room = np.append(room, capacity)
                fits = [len(room) - 1]
            sequence[i], offset[i] = fits[0] * step + step - 1, capacity - room[fits[0]]
            room[fits[0]] -= length[i]
        for name, values in (("sequence_id", sequence), ("offset", offset)):
            table = table.append_column(name, pa.array(values))
        yield from table.to_batches()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, finest: int = FINEST, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    made = stored(pieces(docs, id_col, text_col, path, capacity, finest, with_ids), "pieces")
    spark, kinds = docs.sparkSession, classes(capacity, finest)
    step = len(kinds) + 1
    counts = made.groupBy("_class", "_worker").agg(F.count("*").alias("n"))
    by_class = Window.partitionBy("_class")
    counts = counts.select(
        "_class", "_worker",
        (F.sum("n").over(by_class.orderBy("_worker").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("_base"),
        F.sum("n").over(by_class).alias("_all"),
    )
    per_bin = F.element_at(F.array(*[F.lit(k) for _, k in kinds]), (F.col("_class") + 1).cast("int"))
    dealt = made.join(counts, ["_class", "_worker"]).withColumn("_number", F.col("_number") + F.col("_base")).withColumn("_k", per_bin)
    full = F.col("_number") < F.col("_all") - F.col("_all") % F.col("_k")
    result = ["_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    whole = dealt.filter(full).select(*result, (F.floor(F.col("_number") / F.col("_k")) * step + F.col("_class")).alias("sequence_id"), (F.col("_number") % F.col("_k") * F.col("length")).alias("offset"))
    rest = dealt.filter(~full).select(*result, "_class", "_number").repartition(1)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema) + ", sequence_id long, offset long"
    packed = rest.mapInArrow(_first_fit(capacity, step), kind).select(*result, "sequence_id", "offset")
    return whole.unionByName(packed).withColumnRenamed("_id", id_col)
