"""Incremental index: what to skip, replace and delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import combine_fingerprint, under_root

LEDGER = "source string, fingerprint string, indexed_at timestamp"


def fingerprint_reason(stored: Column, content_hash: Column, signature: Column) -> Column:
    """Why a source must be indexed, or unchanged."""
    parts = F.split(stored, r"\.")
    old_hash, old_sig = parts[0], F.get(parts, F.lit(1))
    return (
        F.when(stored.isNull() | (stored == ""), "never_indexed").when(F.size(parts) < 2, "legacy_format")
        .when((old_hash != content_hash) & (old_sig != signature), "content_and_signature").when(old_hash != content_hash, "content").when(old_sig != signature, "signature").otherwise("unchanged")
    )


def plan_index(files: DataFrame, ledger: DataFrame, signature: str) -> DataFrame:
    """Files (``source, content_hash, available, reason``) with ``fingerprint``, ``action`` and ``why``.

    Runs before conversion, so unchanged files are never converted.
    """
    rows = files.join(ledger.select("source", F.col("fingerprint").alias("stored")), "source", "left")
    rows = rows.withColumn("fingerprint", combine_fingerprint(F.col("content_hash"), F.lit(signature))).withColumn("why", fingerprint_reason(F.col("stored"), F.col("content_hash"), F.lit(signature)))
    action = F.when(~F.col("available"), "unavailable").when(F.col("stored") == F.col("fingerprint"), "skip").otherwise("index")
    return rows.withColumn("action", action)


def vanished(ledger: DataFrame, seen: DataFrame, root: str) -> DataFrame:
    """Stored sources under the root that this run did not see."""
    return ledger.filter(under_root(F.col("source"), F.lit(root))).select("source").join(seen.select("source"), "source", "left_anti")


def delete(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of no source in ``gone``; serves ledger, parents and children alike."""
    return rows.join(gone.select("source").distinct(), "source", "left_anti")


def replace(rows: DataFrame, new: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with those of ``sources`` exchanged for ``new``; doing it twice changes nothing."""
    return delete(rows, sources).unionByName(new, allowMissingColumns=True)


def unchanged(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files whose content hash is already stored, whatever the signature."""
    return files.join(ledger.select("source", F.split("fingerprint", r"\.")[0].alias("content_hash")), ["source", "content_hash"], "left_semi")


def summary(planned: DataFrame, parent_rows: DataFrame, child_rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """One row of counters, with a histogram of the reasons of unavailable files."""
    reasons = planned.filter("action = 'unavailable'").groupBy("reason").agg(F.count("*").alias("n"))
    hist = reasons.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("unsupported_reasons"))
    with_rows = parent_rows.select("source").distinct().withColumn("_has", F.lit(True))
    main = planned.join(with_rows, "source", "left").agg(
        F.count("*").alias("files"), F.count_if(F.col("action") == "skip").alias("skipped"), F.count_if(F.col("action") == "index").alias("indexed"),
        F.count_if((F.col("action") == "index") & F.col("_has").isNull()).alias("empty"), F.count_if(F.col("action") == "unavailable").alias("unsupported"),
        F.count_if(F.col("available") & F.col("reason").isNotNull()).alias("degraded"),
    )
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return main.crossJoin(one(parent_rows, "parents")).crossJoin(one(child_rows, "children")).crossJoin(one(deleted, "deleted")).crossJoin(hist)  # one row each


def corpus_status(files: DataFrame) -> DataFrame:
    """One row: number and bytes of files, how many can be indexed, how many with loss, and a histogram of reasons."""
    hist = files.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"))
    main = files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_bytes"), F.count_if("indexable").alias("indexable"), F.count_if(F.col("indexable") & (F.col("reason") == "degraded")).alias("degraded"), F.count_if(~F.col("indexable")).alias("unsupported"))
    return main.crossJoin(hist)  # one row each


def ledger_rows(ledger: DataFrame, child_rows: DataFrame) -> DataFrame:
    """Per source: number of children and of distinct parents."""
    counts = child_rows.groupBy("source").agg(F.count("*").alias("n_children"), F.countDistinct("parent_id").alias("n_parents"))
    return ledger.join(counts, "source", "left").select("source", "fingerprint", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_parents", F.lit(0)).alias("n_parents"))
