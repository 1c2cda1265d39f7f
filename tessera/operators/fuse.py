"""Fusion, aggregation by parent, diversity and re-ranking of hits.

A hit has ``qid, rank, child_id, score, score_kind``; everything here is partitioned by
``qid`` and works on the few rows that the channels left for each query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import basename, tokens


def rrf(channels: list[DataFrame], k: int = 60, weights: list[float] | None = None) -> DataFrame:
    """Reciprocal-rank fusion: the sum of weight / (k + rank) over the channels; ties go to the earlier channel, then rank."""
    weights = weights or [1.0] * len(channels)
    if len(weights) != len(channels):
        raise ValueError("one weight for each channel")
    together = None
    for number, (hits, weight) in enumerate(zip(channels, weights, strict=True)):
        part = hits.select("qid", "child_id", "rank", F.lit(number).alias("_list"), F.lit(float(weight)).alias("_w"))
        together = part if together is None else together.unionByName(part)
    fused = together.groupBy("qid", "child_id").agg(F.round(F.sum(F.col("_w") / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("_list", "rank")).alias("_first"))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "_first")
    return fused.select("qid", F.row_number().over(order).alias("rank"), "child_id", "score", F.lit("rrf").alias("score_kind"))


def with_parent(hits: DataFrame, children: DataFrame) -> DataFrame:
    return hits.join(children.select("child_id", "parent_id", "child_text", "source"), "child_id")


def best_child(hits: DataFrame, keep_order: bool = False) -> DataFrame:
    """The best child of each parent; the earlier one of equals.  Sorted by score, or (``keep_order``) by the parent's first appearance."""
    per_parent = Window.partitionBy("qid", "parent_id")
    best = hits.withColumn("_first", F.min("rank").over(per_parent)).withColumn("_n", F.row_number().over(per_parent.orderBy(F.col("score").desc(), "rank"))).filter("_n = 1")
    order = Window.partitionBy("qid").orderBy("_first") if keep_order else Window.partitionBy("qid").orderBy(F.col("score").desc(), "_first")
    return best.withColumn("rank", F.row_number().over(order)).drop("_first", "_n")


def cut(hits: DataFrame, n: int) -> DataFrame:
    """The first n of each query."""
    return hits.filter(F.col("rank") <= n)


def mmr_order(score: np.ndarray, unit: np.ndarray, k: int, lam: float) -> list[int]:
    """Places in the order of selection: lam * (min-max scaled score) - (1 - lam) * (largest cosine to what is selected)."""
    span = score.max() - score.min() if len(score) else 0.0
    relevance = (score - score.min()) / span if span > 0 else np.ones(len(score))
    near = np.full(len(score), -np.inf)
    chosen: list[int] = []
    free = np.ones(len(score), bool)
    while free.any() and len(chosen) < k:
        value = np.round(lam * relevance - (1 - lam) * np.where(np.isinf(near), 0.0, near), 12)
        pick = int(np.argmax(np.where(free, value, -np.inf)))
        chosen.append(pick)
        free[pick] = False
        near = np.maximum(near, unit @ unit[pick])
    return chosen


def mmr(hits: DataFrame, vectors: DataFrame, top_k: int, lam: float = 0.7, key: str = "child_id", vector: str = "embedding") -> DataFrame:
    """Maximal marginal relevance: hits in the order of selection, k for each query.

    ``vectors`` is ``key, embedding``; a hit without one has cosine 0 to all.  A query's group is its few candidates.
    """
    held = hits.join(vectors.select(F.col(key), F.col(vector).cast("array<double>").alias("_v")), key, "left")
    kind = held.drop("_v").schema

    def pick(group: pa.Table) -> pa.Table:
        group = group.take(np.argsort(group.column("rank").to_numpy(), kind="stable"))
        rows = [np.array(v) if v else np.zeros(0) for v in group.column("_v").to_pylist()]
        m = np.zeros((len(rows), max(map(len, rows), default=0)))
        for i, v in enumerate(rows):
            m[i, : len(v)] = v
        norm = np.sqrt((m * m).sum(1, keepdims=True))
        order = mmr_order(group.column("score").to_numpy().astype(float), np.divide(m, norm, out=np.zeros_like(m), where=norm > 0), top_k, lam)
        out = group.take(order).drop_columns(["_v"])
        at = out.schema.get_field_index("rank")
        return out.set_column(at, "rank", pa.array(range(1, len(order) + 1), out.schema.field(at).type))

    return held.groupBy("qid").applyInArrow(pick, kind)


def rerank(hits: DataFrame, queries: DataFrame, top_k: int, model: Callable[[list[tuple[str, str]]], list[float]] | None = None) -> DataFrame:
    """Re-scores (question, child text) pairs and cuts.  Without a model, the share of the question's distinct tokens that the text has."""
    pairs = hits.join(queries.select("qid", "question"), "qid")
    if model is None:
        q, t = F.array_distinct(tokens(F.col("question"))), F.array_distinct(tokens(F.col("child_text")))
        score = F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(F.lit(0.0))
    else:

        @F.pandas_udf("double")
        def judged(question: pd.Series, text: pd.Series) -> pd.Series:
            return pd.Series(model(list(zip(question, text, strict=True))), dtype="float64")

        score = judged("question", "child_text")
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "_was")
    got = pairs.withColumn("score", F.round(score, 6)).withColumnRenamed("rank", "_was").withColumn("rank", F.row_number().over(order))
    return got.filter(F.col("rank") <= top_k).select("qid", "rank", *[c for c in hits.columns if c not in ("qid", "rank")])


def channel_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per query, how many children both channels, only the first and only the second found."""
    both = a.select("qid", "child_id", F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select("qid", "child_id", F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    each = both.groupBy("qid", "child_id").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return each.groupBy("qid").agg(F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("both"), F.count_if(F.col("_b") == 0).alias("only_a"), F.count_if(F.col("_a") == 0).alias("only_b"))


@F.arrow_udf(T.StringType())
def _four_digits(scores: pa.Array) -> pa.Array:
    """As the number itself rounds, not its decimal form."""
    return pa.array(["-" if x is None else f"{x:.4f}" for x in scores.to_pylist()], pa.string())


def rows_to_show(hits: DataFrame, limit: int = 10, chars: int = 80) -> DataFrame:
    """The first hits of each question for a table on a screen: rank, score in 4 digits, its scale, file, heading and the beginning of the text."""
    heading = F.col("heading") if "heading" in hits.columns else F.lit(None).cast("string")
    return cut(hits, limit).select(
        "qid", "rank", _four_digits(F.col("score").cast("double")).alias("score"), F.coalesce("score_kind", F.lit("-")).alias("score_kind"),
        basename(F.coalesce("source", F.lit(""))).alias("file"), F.coalesce(F.nullif(heading, F.lit("")), F.lit("-")).alias("heading"), F.translate(F.left(F.coalesce("child_text", F.lit("")), F.lit(chars)), "\n", " ").alias("preview"),
    )
