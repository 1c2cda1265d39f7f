"""BM25: statistics of terms, counted from scratch.  Search goes through ``postings``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.tables import stored

#: The tokens of ``functions.text.TOKEN`` in Python's notation.
TOKEN_WORD = "[a-z0-9]+|[\u4e00-\u9fff]"


@dataclass(frozen=True)
class LexicalIndex:
    """``postings(child_id, term, tf, dl)`` and ``terms(term, df, idf, avg_len)``."""

    postings: DataFrame
    terms: DataFrame


def fit(children: DataFrame, key: str = "child_id", text: str = "child_text") -> LexicalIndex:
    """Statistics over all children, those without tokens included.

    The corpus size and mean length come from one aggregation whose single row is
    joined into the term table.
    """
    cut = children.select(F.col(key), tokens(F.col(text)).alias("_t"))
    stats = cut.agg(F.count("*").alias("n"), (F.sum(F.size("_t")) / F.greatest(F.count("*"), F.lit(1))).alias("avg_len"))
    postings = cut.select(key, F.size("_t").alias("dl"), F.explode("_t").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = cut.select(F.explode(F.array_distinct("_t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return LexicalIndex(postings, weighed(df, stats))


def statistics(children: DataFrame, text: str = "child_text") -> DataFrame:
    """The terms of ``fit``, from one pass over the children: each adds its length to a row without a term, whose count is the number of children."""
    cut = children.select(tokens(F.col(text)).alias("_t"))
    each = cut.select(F.size("_t").alias("length"), F.explode(F.array_append(F.array_distinct("_t"), F.lit(None).cast("string"))).alias("term"))
    counts = stored(each.groupBy("term").agg(F.count("*").alias("df"), F.sum("length").alias("length")), "terms")
    n, length = F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))
    stats = counts.filter("term is null").agg(n.alias("n"), (length / F.greatest(n, F.lit(1))).alias("avg_len"))
    return weighed(counts.filter("term is not null").select("term", "df"), stats)


def weighed(df: DataFrame, stats: DataFrame) -> DataFrame:
    """``term, df, idf, avg_len`` from document frequencies and the one row of ``n`` and ``avg_len``."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.join(F.broadcast(stats)).select("term", "df", idf.alias("idf"), "avg_len")  # the broadcast side is one row
