"""Embeddings: hash vectors in sparse form, a content-keyed cache, and an interface for model providers."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EMBED_BACKOFF, EMBED_BATCH, EMBED_DIM, EMBED_RETRY
from ..functions.text import hash_bucket, tokens
from ..sources.tables import stored

#: Models that this worker has loaded.
MODELS: dict[str, Callable[[list[str]], list[list[float]]]] = {}


def hash_vectors(rows: DataFrame, key: str, text: str, dim: int = EMBED_DIM) -> DataFrame:
    """Sparse unit vectors: ``key, bucket, weight``.  A text without tokens has no rows (the zero vector)."""
    counted = rows.select(F.col(key), F.explode(tokens(F.col(text))).alias("_t")).groupBy(key, hash_bucket(F.col("_t"), dim).alias("bucket")).agg(F.count("*").alias("_n"))
    norms = counted.groupBy(key).agg(F.sqrt(F.sum(F.col("_n") * F.col("_n"))).alias("_norm"))
    return counted.join(norms, key).select(key, "bucket", (F.col("_n") / F.col("_norm")).alias("weight"))


def dense(sparse: DataFrame, key: str, dim: int = EMBED_DIM) -> DataFrame:
    """Sparse vectors as arrays, for the boundary to other systems."""

    @F.arrow_udf("array<double>")
    def filled(pairs: pa.Array) -> pa.Array:
        flat = pairs.flatten()
        out = np.zeros((len(pairs), dim))
        owner = np.repeat(np.arange(len(pairs)), pairs.value_lengths().to_numpy(zero_copy_only=False))
        out[owner, flat.field("bucket").to_numpy(zero_copy_only=False)] = flat.field("weight").to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(pairs) + 1, dtype=np.int32) * dim), pa.array(out.ravel()))

    return sparse.groupBy(key).agg(F.collect_list(F.struct("bucket", "weight")).alias("_p")).select(key, filled("_p").alias("embedding"))


def cached(rows: DataFrame, cache: DataFrame, text: str, provider: Callable[[list[str]], list[list[float]]], dim: int, **options) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``embedding``, and what the cache (``key, embedding``) is to be extended by.

    Only distinct texts that the cache lacks go to the provider; they are written before they are used, so each
    is asked for once.  Both are then joined back by key.
    """
    fresh = embed(cache_misses(rows, cache, text), "text", provider, dim, **options).select("key", "embedding")
    fresh = stored(fresh, "embedded")
    every = cache.select("key", F.col("embedding").cast("array<float>").alias("embedding")).unionByName(fresh)
    return rows.withColumn("key", text_key(F.col(text))).join(every, "key", "left").drop("key"), fresh


def text_key(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def cache_misses(rows: DataFrame, cache: DataFrame, text: str) -> DataFrame:
    """``key, text`` of the distinct texts that the cache (``key, embedding``) has no vector of."""
    wanted = rows.select(text_key(F.col(text)).alias("key"), F.col(text).alias("text")).groupBy("key").agg(F.min("text").alias("text"))
    return wanted.join(cache.select("key"), "key", "left_anti")


def lazily(make: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[list[str]], list[list[float]]]:
    """A provider whose model is loaded by ``make`` in the worker that first needs it, and kept there.

    What is sent to the workers is ``make``, not the model.
    """
    name = f"{make.__module__}.{make.__qualname__}.{uuid.uuid4().hex}"

    def provider(texts: list[str]) -> list[list[float]]:
        from tessera.operators import embed as here  # this module as the worker has it, not a copy with the function

        if name not in here.MODELS:
            here.MODELS[name] = make()
        return here.MODELS[name](texts)

    return provider


def embed(rows: DataFrame, text: str, provider: Callable[[list[str]], list[list[float]]], dim: int, batch: int = EMBED_BATCH, retry: int = EMBED_RETRY, backoff: float = EMBED_BACKOFF) -> DataFrame:
    """Adds ``embedding`` by a provider's batched calls, with retries and a check of the dimension."""
    if batch <= 0:
        raise ValueError("batch must be positive")

    def call(texts: list[str]) -> list[list[float]]:
        for attempt in range(retry):
            try:
                got = provider(texts)
                break
            except Exception:
                if attempt + 1 == retry:
                    raise
                time.sleep(backoff * 2**attempt)
        if len(got) != len(texts) or any(len(v) != dim for v in got):
            raise ValueError(f"the provider must return one vector of {dim} numbers for each text")
        return got

    @F.arrow_udf("array<float>")
    def udf(column: pa.Array) -> pa.Array:
        texts = [t or "" for t in column.to_pylist()]
        return pa.array([v for i in range(0, len(texts), batch) for v in call(texts[i : i + batch])], pa.list_(pa.float32()))

    return rows.withColumn("embedding", udf(F.col(text)))
