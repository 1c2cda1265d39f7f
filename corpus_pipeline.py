"""A training-data pipeline over ``documents``: each stage works on all that its predecessor kept.

Stages read what they need besides documents (labels) from ``sf_dir``; the input
of every stage after the first is a written table.

Defined cases: a null, empty or short text fails the rules; rows with a null id are documents like others; of repeated
rows and other near-duplicates one stays; texts of any length are whole; columns besides those of documents, whatever
their names, pass all stages but packing, which returns its own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import packing, quality_classifier, quality_rules, shingle_sets, substring
from tessera.llm.common import stored, table

#: Near-duplicates on word shingles take five words here.
SHINGLE = 5


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the tokeniser-fertility bands."""
    return quality_rules.keep(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from all labelled documents of the table, scores at 0.7 or more."""
    weights = quality_classifier.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_classifier.keep(docs, weights)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    SimHash fingerprints at anchors find the closest pairs, shingles of the sets' prefixes the others; each pair is confirmed by the whole sets.
    """
    return shingle_sets.keep_one(docs, shingle=SHINGLE)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that stand elsewhere too; ``n_chars`` follows."""
    return substring.remove(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("near-duplicates", near_dedup), ("substring dedup", substrings), ("packing", pack)]

#: The stages train a model, sample nothing and tokenise: not within reach of SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
