"""Exact top-k by inner product, block at a time with pruning.

Vectors are integers (floor(scale * x)).  They are ordered by the nearest of a few pivots and
then by id, cut into shards by range and, within a shard, into blocks of
consecutive vectors.  A block keeps the largest and least value of each dimension
("term"), and its vectors as a forward index.  For a query, a block's bound is the sum over
the dimensions of the query's value times the block's largest value (least, where the
query's is negative).  Blocks are taken in order of their bounds and scored through the
forward index until the next bound falls below the k-th best score so far; an equal
bound is still scored, as a tie may go to a smaller id.

The blocks are written once, and a shard keeps the largest and least values of its blocks; there are at most
MAX_SHARDS shards, so these summaries are of bounded size and are sent to all tasks.  In a first pass each query
goes to the shard with its greatest bound, and the k-th best score found there is a floor.  In a second pass
it goes to those other shards alone whose bound reaches the floor, and starts from it.  A shard that many
queries go to is searched by groups of at most about QUERY_GROUP.  Each (shard, group) pair gives at most k rows a query, and a window
over a query's rows gives the whole result.  Pivots only improve the order; any choice gives the same result.

Defined cases: vectors that are null, or hold a null or non-finite component, and rows with a
null id take no part; of vectors of different lengths, missing components are zero; a
query's candidates are all rows with another id; repeated query rows each get their
result; with fewer candidates than k, all are returned; values beyond a long saturate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE = 1024
BLOCK = 128
SHARD = 16_384
QUERY_GROUP = 2048
PIVOTS = 64
MAX_SHARDS = 8192
#: Queries whose bounds with all shards are worked out at a time, and rows sent on at a time.
_AT_A_TIME, _SENT = 256, 2048
_NONE = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``id, v`` of the rows that take part."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & whole)
    return some.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrix(column) -> np.ndarray:
    """List column -> int64 matrix, short rows filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, size = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = flat
    return out


def _wide(m: np.ndarray, d: int) -> np.ndarray:
    return m if m.shape[1] == d else np.pad(m, ((0, 0), (0, d - m.shape[1])))


def _bytes(m: np.ndarray) -> bytes:
    return np.ascontiguousarray(m, "<i8").tobytes()


def _nearest(pivots: np.ndarray):
    def run(batches):
        for batch in batches:
            m = _matrix(batch.column("v"))
            d = max(m.shape[1], pivots.shape[1])
            p = _wide(pivots, d).astype(float)
            near = (_wide(m, d).astype(float) @ p.T - (p * p).sum(1) / 2).argmax(1) if len(p) else np.zeros(len(m))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(near.astype(np.int32))], ["id", "v", "pivot"])

    return run


def _packed(size: int):
    """Consecutive rows of a shard -> blocks with their vectors, and each dimension's largest and least value."""
    kind = pa.schema([("shard", pa.int32()), ("n", pa.int32()), ("d", pa.int32()), ("ids", pa.binary()), ("values", pa.binary()), ("high", pa.binary()), ("low", pa.binary())])

    def run(batches):
        shard, rest = TaskContext.get().partitionId(), None

        def made(table):
            m = _matrix(table.column("v"))
            row = {"shard": shard, "n": len(m), "d": m.shape[1], "ids": _bytes(table.column("id").to_numpy()), "values": _bytes(m), "high": _bytes(m.max(0)), "low": _bytes(m.min(0))}
            return pa.RecordBatch.from_pylist([row], schema=kind)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            while rest.num_rows >= size:
                yield made(rest.slice(0, size))
                rest = rest.slice(size)
        if rest is not None and rest.num_rows:
            yield made(rest)

    return run


def _exact(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> type:
    """The numbers to reckon with: doubles, if all products and sums of these stay exact, else longs."""
    reach = float(np.abs(queries).astype(float).sum(1).max(initial=0)) * max(1.0, float(np.maximum(np.abs(high.astype(float)), np.abs(low.astype(float))).max(initial=0)))
    return np.float64 if reach < 2.0**53 else np.int64


def _bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query, what no vector between ``low`` and ``high`` scores more than."""
    kind = _exact(queries, high, low)
    q = queries.astype(kind)
    return np.maximum(q, 0) @ high.T.astype(kind) + np.minimum(q, 0) @ low.T.astype(kind)


def _summary(table: pa.Table) -> pa.Table:
    """Largest and least values of a shard's blocks."""
    d = max(table.column("d").to_pylist())
    high, low = ([_wide(np.frombuffer(b, "<i8").reshape(1, -1), d)[0] for b in table.column(name).to_pylist()] for name in ("high", "low"))
    row = {"shard": table.column("shard")[0].as_py(), "high": np.max(high, 0).tolist(), "low": np.min(low, 0).tolist()}
    return pa.Table.from_pylist([row], schema=pa.schema([("shard", pa.int32()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))]))


def _sent(summaries, first: bool):
    """Queries -> a row for each shard that they go to: the one with the greatest bound, or all others whose bound reaches the floor."""
    kind = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("v", pa.list_(pa.int64())), ("floor", pa.int64()), ("shard", pa.int32())])

    def run(batches):
        shards, high, low = summaries.value
        if not len(shards):
            return
        for batch in (b.slice(i, _AT_A_TIME) for b in batches for i in range(0, b.num_rows, _AT_A_TIME)):
            m = _matrix(batch.column("v"))
            d = max(m.shape[1], high.shape[1])
            bound = _bounds(_wide(m, d), _wide(high, d), _wide(low, d))
            if first:
                row, col = np.arange(len(m)), bound.argmax(1)
                floor = np.full(len(m), _NONE)
            else:
                floor = batch.column("floor").to_numpy()
                row, col = np.nonzero((bound >= floor[:, None]) & (shards[None, :] != batch.column("shard").to_numpy()[:, None]))
            for a in range(0, len(row), _SENT):
                r, c = row[a : a + _SENT], col[a : a + _SENT]
                take = pa.array(r)
                yield pa.RecordBatch.from_arrays([*(batch.column(n).take(take) for n in ("q", "query_id", "v")), pa.array(floor[r]), pa.array(shards[c])], schema=kind)

    return run


def search_blocks(query_ids: np.ndarray, queries: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Per query the k best (scores, ids, how many); and how many (query, block) pairs were scored.

    ``blocks``: ids, vectors, largest and least values, all of the queries' width.  ``floor``: for each query a
    score that its k best are known to reach; blocks below it are not scored.
    """
    n, nb = len(queries), len(blocks)
    high, low = np.stack([b[2] for b in blocks]), np.stack([b[3] for b in blocks])
    kind = _exact(queries, high, low)
    q, bound = queries.astype(kind), _bounds(queries, high, low)
    floor = np.full(n, _NONE) if floor is None else floor
    order = np.argsort(-bound, axis=1, kind="stable")
    values = [b[1].astype(kind) for b in blocks]
    none = _NONE
    score, ident, held, scored = np.full((n, k), none), np.full((n, k), np.iinfo(np.int64).max), np.zeros(n, np.int64), 0
    everyone = np.arange(n)
    active = everyone
    for r in range(nb):
        best = order[active, r]
        open_ = (bound[active, best] >= floor[active]) & ((held[active] < k) | (bound[active, best] >= score[active, k - 1]))
        active, best = active[open_], best[open_]
        if not len(active):
            break
        scored += len(active)
        by = np.argsort(best, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], best[by][1:] != best[by][:-1], [True]]))
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            who, b = active[by[a:z]], best[by[a]]
            new = (q[who] @ values[b].T).astype(np.int64)
            ids = np.broadcast_to(blocks[b][0], new.shape)
            own = ids == query_ids[who][:, None]
            s = np.concatenate([score[who], np.where(own, none, new)], 1)
            i = np.concatenate([ident[who], np.where(own, np.iinfo(np.int64).max, ids)], 1)
            top = np.lexsort((i, ~s), axis=-1)[:, :k]
            score[who], ident[who] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
            held[who] = np.minimum(k, held[who] + (~own).sum(1))
    return score, ident, held, scored


def _search(k: int):
    kind = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return kind.empty_table()
        queries = _matrix(right.column("v"))
        d = max(max(left.column("d").to_pylist()), queries.shape[1])

        def part(row: dict, name: str, rows: int) -> np.ndarray:
            return _wide(np.frombuffer(row[name], "<i8").reshape(rows, row["d"]), d)

        blocks = [(np.frombuffer(b["ids"], "<i8"), part(b, "values", b["n"]), part(b, "high", 1)[0], part(b, "low", 1)[0]) for b in left.to_pylist()]
        ids = right.column("query_id").to_numpy()
        score, ident, held, _ = search_blocks(ids, _wide(queries, d), blocks, k, right.column("floor").to_numpy())
        row, col = np.nonzero(np.arange(k)[None, :] < held[:, None])
        return pa.table([pa.array(x) for x in (right.column("q").to_numpy()[row], ids[row], ident[row, col], score[row, col])], schema=kind)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``is_query`` picks, its k best other rows."""
    spark = vectors.sparkSession
    valid = quantised(vectors, id_col, vector_col, scale)
    asked = quantised(vectors.filter(is_query), id_col, vector_col, scale)
    shards = min(MAX_SHARDS, max(1, -(-valid.count() // shard)))
    chosen = valid.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).toArrow()  # at most PIVOTS rows
    pivots = _matrix(chosen.column("v")) if chosen.num_rows else np.zeros((0, 0), np.int64)
    near = valid.mapInArrow(_nearest(pivots), "id long, v array<bigint>, pivot int")
    index = near.repartitionByRange(shards, "pivot", "id").sortWithinPartitions("pivot", "id")
    index = stored(index.mapInArrow(_packed(block), "shard int, n int, d int, ids binary, values binary, high binary, low binary"), "blocks")
    bounds = index.select("shard", "d", "high", "low").groupBy("shard").applyInArrow(_summary, "shard int, high array<bigint>, low array<bigint>").orderBy("shard").toArrow()  # at most MAX_SHARDS rows
    summaries = spark.sparkContext.broadcast((bounds.column("shard").to_numpy(), _matrix(bounds.column("high")), _matrix(bounds.column("low"))))
    row = "q long, query_id long, v array<bigint>, floor long, shard int"
    asked = asked.select(F.monotonically_increasing_id().alias("q"), F.col("id").alias("query_id"), "v")
    best = stored(asked.mapInArrow(_sent(summaries, True), row), "best-shard")
    first = stored(_searched(index, best, k), "first")
    floors = first.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    others = best.drop("floor").join(floors, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(_NONE)))
    others = stored(others.select("q", "query_id", "v", "floor", "shard").mapInArrow(_sent(summaries, False), row), "other-shards")
    found = first.unionByName(_searched(index, others, k))
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of each query in the shard it was sent to.  Shards are read again for each group of their queries."""
    groups = queries.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_GROUP).cast("int").alias("groups"))  # at most MAX_SHARDS rows
    blocks = index.join(F.broadcast(groups), "shard").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    dealt = queries.join(F.broadcast(groups), "shard").withColumn("group", F.pmod(F.xxhash64("q"), F.col("groups")).cast("int")).drop("groups")
    return blocks.groupBy("shard", "group").cogroup(dealt.groupBy("shard", "group")).applyInArrow(_search(k), "q long, query_id long, vec_id long, score long")
