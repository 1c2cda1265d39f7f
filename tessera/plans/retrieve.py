"""Batch plans: from documents to parents and children, and from questions to prompts."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ABLATIONS, EMBED_DIM, Budget, Chunking, Retrieval
from ..operators import chunk, contain, context, embed, fuse, postings, vector
from ..sources.tables import spread, stored


@dataclass(frozen=True)
class Corpus:
    parents: DataFrame
    children: DataFrame


def corpus(documents: DataFrame, params: Chunking | None = None) -> Corpus:
    """Chunks of a ``documents`` table; the id is the source and gives the label."""
    docs = spread(documents.select("doc_id", "text")).select(F.col("doc_id").cast("string").alias("source"), "text", F.concat(F.lit("doc_"), F.col("doc_id")).alias("label"))
    parents = chunk.parents(docs, label="label", params=params)
    return Corpus(parents, chunk.children(parents, params))


def written(c: Corpus) -> Corpus:
    """The same as tables, for plans that read the chunks more than once: they are made once."""
    parents = stored(c.parents, "parents")
    return Corpus(parents, stored(c.children, "children"))


def questions(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def keyword_hits(c: Corpus, asked: DataFrame, p: Retrieval, shards: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """From shards (``postings.build``) and statistics that are there, or made for these questions."""
    shards = postings.build(c.children) if shards is None else shards
    return postings.search(shards, postings.statistics(shards) if terms is None else terms, asked, p.candidates, p)


def vector_hits(c: Corpus, asked: DataFrame, p: Retrieval, dim: int = EMBED_DIM) -> DataFrame:
    """Hash vectors: no model is needed."""
    return vector.hash_top_n(c.children, asked, p.candidates, p.min_sim, dim)


def candidates(c: Corpus, asked: DataFrame, p: Retrieval) -> DataFrame:
    """Fused, one child for each parent, cut to the candidates: in this order.  A written table of a few rows a question."""
    return _best_parents(c, fuse.rrf(list(both_channels(c, asked, p)), p.rrf_k) if p.use_bm25 else vector_hits(c, asked, p), p)


def both_channels(c: Corpus, asked: DataFrame, p: Retrieval, dim: int = EMBED_DIM) -> tuple[DataFrame, DataFrame]:
    """The hits of the vector and of the keyword channel, from the same shards: children are cut into tokens once."""
    shards = postings.build(c.children)
    return postings.hash_top_n(shards, asked, p.candidates, p.min_sim, dim), keyword_hits(c, asked, p, shards)


def _best_parents(c: Corpus, found: DataFrame, p: Retrieval) -> DataFrame:
    return stored(fuse.cut(fuse.best_child(fuse.with_parent(found, c.children)), p.candidates), "candidates")


def _diverse(c: Corpus, found: DataFrame, p: Retrieval, dim: int) -> DataFrame:
    few = c.children.join(found.select("child_id").distinct(), "child_id", "left_semi")
    return fuse.mmr(found, embed.dense(embed.hash_vectors(few, "child_id", "child_text", dim), "child_id", dim), p.top_k, p.mmr_lambda)


def retrieve(c: Corpus, asked: DataFrame, p: Retrieval | None = None, dim: int = EMBED_DIM) -> DataFrame:
    """The top_k hits of each question."""
    p = p or Retrieval()
    found = candidates(c, asked, p)
    return _diverse(c, found, p, dim) if p.use_mmr else fuse.cut(found, p.top_k)


def ablated(c: Corpus, asked: DataFrame, p: Retrieval, dim: int = EMBED_DIM) -> DataFrame:
    """The hits of all ablation runs, with ``run``: each channel searches once, and each set of candidates serves the runs with and without diversity."""
    vectors, words = (stored(hits, "hits") for hits in both_channels(c, asked, p, dim))
    both = fuse.rrf([vectors, words], p.rrf_k)
    sets = {with_words: _best_parents(c, both if with_words else vectors, p) for with_words in sorted({bm25 for bm25, _ in ABLATIONS.values()})}
    runs = [(_diverse(c, sets[bm25], p, dim) if mmr else fuse.cut(sets[bm25], p.top_k)).withColumn("run", F.lit(run)) for run, (bm25, mmr) in ABLATIONS.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)


def packed(c: Corpus, asked: DataFrame, p: Retrieval | None = None, b: Budget | None = None) -> DataFrame:
    return context.pack(retrieve(c, asked, p), c.parents, asked, b)


def prompts(c: Corpus, asked: DataFrame, p: Retrieval | None = None, b: Budget | None = None, strict: bool = False) -> DataFrame:
    rows = packed(c, asked, p, b)
    return rows.withColumn("prompt", context.render_prompt(F.col("blocks"), F.col("question"), strict))


def golden_from(benchmark: DataFrame, documents: DataFrame) -> DataFrame:
    """A golden set of a ``benchmark`` table: an item is answerable if a document holds its whole text.

    The anchor is the text's first 60 characters, as a passage may be cut between two parents.
    """
    asked = questions(benchmark)
    held = contain.containing(spread(documents.select("text")), "text", asked, "question").distinct().withColumn("answerable", F.lit(True))
    anchor = F.struct(F.lit("").alias("source"), F.lit("").alias("heading_contains"), F.left("question", F.lit(60)).alias("text_contains"))
    return asked.join(held, "question", "left").select("qid", "question", F.array(anchor).alias("anchors"), F.coalesce("answerable", F.lit(False)).alias("answerable"), F.lit(True).alias("reviewed"))
