"""Continuous indexing: each micro-batch of documents replaces its sources in the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Chunking, index_signature
from ..functions.text import fingerprint
from ..operators import chunk
from ..operators.index import LEDGER, plan_index
from ..operators.store import Store


def latest(docs: DataFrame, order: str | None = "version") -> DataFrame:
    """The last of several rows of a source, by the column ``order``; a null is before all.

    Equal ones, and all where there is no such column, can't be told apart: the one with the greatest hash of
    its content is taken, so that the choice doesn't depend on partitioning.
    """
    content = F.sha2(F.concat_ws("\0", F.coalesce("text", F.lit("")), F.coalesce("label", F.lit(""))), 256)
    by = [F.col(order).isNotNull(), F.col(order)] if order and order in docs.columns else []
    return docs.groupBy("source").agg(F.max_by(F.struct("text", "label"), F.struct(*by, content)).alias("d")).select("source", "d.*")


def index_batch(store: Store, docs: DataFrame, params: Chunking | None = None, identity: str = "hash:1536", order: str | None = "version") -> dict[str, int]:
    """Indexes documents (``source, text, label``, and ``order``) that are new or changed; returns how many were indexed and skipped.

    A micro-batch may be run again after a failure: what it has written is then found unchanged.
    """
    params = params or Chunking()
    files = latest(docs, order)
    files = files.withColumn("content_hash", fingerprint(F.encode("text", "UTF-8"))).withColumn("available", F.lit(True)).withColumn("reason", F.lit(None).cast("string"))
    ledger = store.read("ledger")
    if ledger is None:
        ledger = docs.sparkSession.createDataFrame([], LEDGER)
    planned = plan_index(files, ledger, index_signature(params, identity)).persist()
    try:
        counts = {r.action: r["count"] for r in planned.groupBy("action").count().collect()}
        if counts.get("index"):
            new = planned.filter("action = 'index'")
            parents = chunk.parents(new, label="label", params=params)
            rows = new.select("source", "fingerprint", F.current_timestamp().alias("indexed_at"))
            store.sync(rows, parents, lambda written: chunk.children(written, params), ledger.select("source").limit(0))
    finally:
        planned.unpersist()
    return {"indexed": counts.get("index", 0), "skipped": counts.get("skip", 0)}


def start(stream: DataFrame, store: Store, checkpoint: str, params: Chunking | None = None, order: str | None = "version") -> StreamingQuery:
    """Runs ``index_batch`` over a stream of documents until what is there is done."""
    return stream.writeStream.foreachBatch(lambda batch, _: index_batch(store, batch, params, order=order) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
