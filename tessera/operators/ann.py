"""Approximate vector search by cosine: coarse lists, product-quantised residuals, exact scores for what they leave.

A bounded sample of the vectors, those with the least hash of their key, is clustered on the driver: into lists, and the rest of each vector
but its list's centre, in SUBSPACES parts, into CODES centres a part.  Every row is then indexed: its list and a code byte a part.  The
index is written in order of list and key, in ranges, so a list that holds a third of all rows is spread over tasks, and a search
for a few lists skips the others' row groups.

A question looks into the lists whose centres are nearest.  How many that takes is measured on the sample, by exact search of held-out
questions, as the least number that finds PROBE_RECALL of their neighbours.  In a list, the code bytes give each row an approximate score from a table of the
question, and the length of what the codes leave out says how far off it may be.  Rows that may be among the n best by that are scored exactly, from the vectors
beside them, in the same task: few where codes are good, all in a crowd too tight for them.  What is shuffled is n rows for a question and task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .vector import NOISE, _matrix, _unit

#: Vectors that are clustered, at most; and held-out questions that probes are measured by.
SAMPLE, HELD_OUT = 50_000, 200
#: Lists, at most; parts of a vector and centres of a part.
LISTS, SUBSPACES, CODES = 4096, 8, 256
ROUNDS = 12
PROBE_RECALL = 0.97
#: An inner product is off by the left-out length over the square root of the dimension, as a standard deviation; so many of them are allowed for.
SPREAD = 3.0
#: Tables of the questions that a task holds at a time, in bytes.
TABLE_BYTES = 32 << 20


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, some rows at a time."""
    half = (centres * centres).sum(1) / 2
    step = max(1, (1 << 22) // max(1, len(centres)))
    return np.concatenate([np.argmax(x[i : i + step] @ centres.T - half, 1) for i in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def clustered(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Centres by Lloyd's rounds; an empty one moves to the row that is farthest from its centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        order = np.argsort(at, kind="stable")
        full = np.flatnonzero(n)
        centres[full] = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0) / n[full, None]
        empty = np.flatnonzero(n == 0)
        if len(empty):
            far = np.argsort(-((x - centres[at]) ** 2).sum(1), kind="stable")[: len(empty)]
            centres[empty[: len(far)]] = x[far]
    return centres


@dataclass(frozen=True)
class Model:
    """``centres`` of the lists; ``codes``: an array for each part of a vector; ``probes``: lists that a question looks into."""

    centres: np.ndarray
    codes: list[np.ndarray]
    probes: int

    @property
    def edges(self) -> list[int]:
        return np.concatenate([[0], np.cumsum([c.shape[1] for c in self.codes])]).tolist()

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List and code bytes of each (unit) row, and the length of what they leave out."""
        at = _nearest(x, self.centres)
        rest = x - self.centres[at]
        parts = []
        for a, b, c in zip(self.edges, self.edges[1:], self.codes):
            parts.append(_nearest(rest[:, a:b], c))
            rest[:, a:b] -= c[parts[-1]]
        return at, np.stack(parts, 1).astype(np.uint8), np.sqrt((rest * rest).sum(1)).astype(np.float32)

    def lists(self, q: np.ndarray) -> np.ndarray:
        """The lists that each question looks into."""
        score = q @ self.centres.T - (self.centres**2).sum(1) / 2
        return np.argsort(-score, 1, kind="stable")[:, : self.probes]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each question, part and code, what the code adds to the inner product."""
        out = np.zeros((len(q), len(self.codes), CODES), np.float32)
        for s, (a, b, c) in enumerate(zip(self.edges, self.edges[1:], self.codes)):
            out[:, s, : len(c)] = q[:, a:b] @ c.T
        return out


def probes_for(x: np.ndarray, centres: np.ndarray, n: int, recall: float = PROBE_RECALL) -> int:
    """The least number of lists that hold so much of the n nearest rows of held-out ones, on average."""
    q = x[:: max(1, len(x) // HELD_OUT)][:HELD_OUT]
    score = q @ x.T
    best = np.argpartition(-score, min(n, len(x) - 1), 1)[:, : n + 1]
    order = np.argsort(-(q @ centres.T - (centres**2).sum(1) / 2), 1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(centres))[None, :], 1)
    needed = np.take_along_axis(rank, _nearest(x, centres)[best], 1)
    share = np.cumsum(np.bincount(needed.ravel(), minlength=len(centres))) / needed.size
    return int(np.searchsorted(share, recall)) + 1


def train(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", n: int = 20, lists: int | None = None, recall: float = PROBE_RECALL) -> Model | None:
    """A model for searches of the ``n`` nearest rows; None without a vector."""
    rows = vectors.filter(F.col(key).isNotNull() & (F.size(vector) > 0)).select(F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v"))
    total = rows.count()
    if not total:
        return None
    some = rows.withColumn("_h", F.xxhash64("_k", F.lit(11))).filter(F.pmod("_h", F.lit(max(1, total // (2 * SAMPLE)))) == 0).orderBy("_h").limit(SAMPLE)
    x = _unit(np.nan_to_num(_matrix(some.toArrow().column("_v"))))
    k = lists or max(1, min(LISTS, round(total**0.5), len(x) // 8))
    centres = clustered(x, k)
    rest = x - centres[_nearest(x, centres)]
    edges = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
    codes = [clustered(rest[:, a:b], CODES, seed=1) for a, b in zip(edges, edges[1:])]
    return Model(centres, codes, min(len(centres), probes_for(x, centres, n, recall)))


def build(vectors: DataFrame, model: Model | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Every row that has a key and a vector, with ``list`` and ``code``: a written table, in order of list and key."""
    width = 0 if model is None else model.centres.shape[1]
    rows = vectors.filter(F.col(key).isNotNull() & (F.size(vector) > 0)).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))

    sent = vectors.sparkSession.sparkContext.broadcast(model)  # at most LISTS centres

    def run(batches):
        model = sent.value
        for batch in batches:
            x = _unit(np.nan_to_num(_fitted(_matrix(batch.column("vector")), width)))
            at, code, out = model.coded(x)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("vector"), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(out)], ["key", "vector", "list", "code", "left_out"])

    ktype = rows.schema["key"].dataType.simpleString()
    if model is None:
        return rows.limit(0).selectExpr("key", "vector", "0 as list", "cast('' as binary) as code", "cast(0 as float) as left_out")
    coded = rows.mapInArrow(run, f"key {ktype}, vector array<double>, list int, code binary, left_out float")
    return stored(coded.repartitionByRange("list", "key").sortWithinPartitions("list", "key"), "lists")


def _fitted(x: np.ndarray, width: int) -> np.ndarray:
    """With as many columns as the model's vectors have."""
    return x[:, :width] if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def search(index: DataFrame, model: Model | None, queries: DataFrame, n: int, min_sim: float | None = None, key: str = "vec_id", qid: str = "qid", query_vector: str = "embedding") -> DataFrame:
    """``qid, rank, key, score, score_kind, probed``: the n best rows found for each question with a cosine of at least ``min_sim`` (ties to the least key), and
    how many rows were in the lists that it looked into."""
    spark = index.sparkSession
    asked = queries.select(F.col(qid).alias("_q"), F.col(query_vector).cast("array<double>").alias("_v")).filter("_q is not null and _v is not null")
    qtype, ktype = asked.schema["_q"].dataType.simpleString(), index.schema["key"].dataType.simpleString()
    kind = f"_q {qtype}, _k {ktype}, score double"
    if model is None:
        return spark.createDataFrame([], kind).select(F.col("_q").alias(qid), F.lit(1).alias("rank"), F.col("_k").alias(key), "score", F.lit("cosine").alias("score_kind"), F.lit(0).cast("long").alias("probed"))
    width = model.centres.shape[1]
    passes = max(1, -(-asked.count() * (4 * len(model.codes) * CODES + 8 * width) // TABLE_BYTES))
    sizes = index.groupBy("list").count()
    found = looked = None
    for number in range(passes):
        part = asked.filter(F.pmod(F.xxhash64("_q"), F.lit(passes)) == number).toArrow()
        ids = part.column("_q").combine_chunks() if part.num_rows else pa.array([], part.schema.field("_q").type)
        q = _unit(_fitted(np.nan_to_num(_matrix(part.column("_v"))), width)) if part.num_rows else np.zeros((0, width))
        probed = model.lists(q) if len(q) else np.zeros((0, 1), np.int64)
        sent = spark.sparkContext.broadcast((ids, q, probed, model))
        pairs = spark.createDataFrame(pa.table({"_q": ids.take(pa.array(np.repeat(np.arange(len(q)), probed.shape[1]))), "list": pa.array(probed.ravel().astype(np.int32))})) if len(q) else None

        def run(batches, sent=sent):
            ids, q, probed, model = sent.value
            tables, spread = model.tables(q), SPREAD / max(1, q.shape[1]) ** 0.5
            order = np.argsort(probed.ravel(), kind="stable")
            who, which = order // probed.shape[1], probed.ravel()[order]
            floors = np.full((len(q), n), -np.inf)
            for batch in batches:
                at = batch.column("list").to_numpy()
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                vectors = _unit(_fitted(np.nan_to_num(_matrix(batch.column("vector"))), q.shape[1]))
                keys, out = batch.column("key"), batch.column("left_out").to_numpy()
                place = np.empty(len(keys), np.int64)
                place[pc.array_sort_indices(keys).to_numpy()] = np.arange(len(keys))
                rows, cols, scores = [], [], []
                edges = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])) if len(at) else np.zeros(1, int)
                for a, b in zip(edges, edges[1:]):
                    own = who[np.searchsorted(which, at[a]) : np.searchsorted(which, at[a], side="right")]
                    for i in range(0, len(own), max(1, (1 << 21) // (b - a))):
                        some = own[i : i + max(1, (1 << 21) // (b - a))]
                        rough = sum(tables[some, s][:, code[a:b, s]] for s in range(code.shape[1]))
                        off = spread * out[a:b]
                        for j, asker in enumerate(some.tolist()):
                            likely = rough[j] + q[asker] @ model.centres[at[a]]
                            floor = floors[asker, 0]
                            if b - a > n:
                                floor = max(floor, float(np.partition(likely - off, b - a - n)[b - a - n]))
                            row = np.flatnonzero(likely + off >= floor) + a
                            raw = vectors[row] @ q[asker]
                            score = np.round(raw, 6)
                            keep = (score >= floors[asker, 0]) & (True if min_sim is None else raw >= min_sim - NOISE)
                            row, score = row[keep], score[keep]
                            first = np.lexsort((place[row], -score))[:n]
                            if len(first):
                                floors[asker] = np.sort(np.concatenate([floors[asker], score[first]]))[-n:]
                                rows.append(row[first])
                                cols.append(np.full(len(first), asker))
                                scores.append(score[first])
                if rows:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(cols))), keys.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(scores))], ["_q", "_k", "score"])

        got = index.mapInArrow(run, kind)
        found = got if found is None else found.unionByName(got)
        if pairs is not None:
            looked = pairs if looked is None else looked.unionByName(pairs)
    order = Window.partitionBy("_q").orderBy(F.col("score").desc(), "_k")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    counts = spark.createDataFrame([], f"_q {qtype}, probed long") if looked is None else looked.join(F.broadcast(sizes), "list").groupBy("_q").agg(F.sum("count").alias("probed"))  # a row for each list
    return ranked.join(counts, "_q").select(F.col("_q").alias(qid), "rank", F.col("_k").alias(key), "score", F.lit("cosine").alias("score_kind"), "probed")
