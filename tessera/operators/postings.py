"""Keyword search through postings: shards of children, block maxima, and blocks that are skipped once they can't matter.

Each task that reads children cuts them into shards of at most SHARD; a shard is one row: its children's ids and lengths, its terms, and for each term the
children that hold it, with frequencies, in blocks: a block is what a term has in a range of RANGE children, who are numbered in 8 bits from
the range's first.  Of each block the greatest frequency and the least length are kept; they bound its BM25 whatever the statistics are, so shards need not be
written again as the corpus grows.  A term that most children hold has blocks in each shard, so no task gets its list whole.

Search sends the questions' term weights to the shards, in parts of bounded size.  In a shard, the bounds of a question's blocks are summed by range, the heaviest terms first.
Ranges whose sum is below the n-th best score so far are never opened.  In the others only the first terms, up to where what is left can't reach that score by
itself, bring in children (MaxScore, range by range); of the remaining terms only the postings of children that can still get there are scored.
What a task leaves is n rows a question.  First, of a few
shards only the ranges with the greatest bounds are scored; the n-th best of all these is what has to be beaten everywhere.

A shard has some megabytes.  So the table of them is written in row groups of a few, and a few go to Python at a time: no task holds all shards of its files.

Document frequencies and lengths are read off the shards, so texts are cut into tokens once.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Retrieval
from ..functions.text import tokens
from ..sources.tables import few_at_a_time, stored
from .lexical import TOKEN_WORD, weighed
from .vector import ORDER, ROWS, Buckets, hash_search, in_order, ranked_children

#: Children of a shard, at most 2**16, and of a range, at most 2**8.
SHARD, RANGE = 4096, 4
#: Term weights of questions that are sent to the shards in one pass.
WEIGHTS = 2_000_000
#: Groups that a question's terms are taken in, by falling weight.
GROUPS = 8
#: Shards that tell what is to be beaten.
SEEDS = 16
#: What separates a score from one that is equal but for the order of its sums.
NOISE = 1e-6
#: Shards that a worker gets at a time, and bytes of a row group of them.
AT_A_TIME, GROUP_BYTES = 2, 16 << 20
#: ``seed``: one of the first SEEDS shards of its task; ``name``: the id of its first child.
SHARDS = "seed boolean, name string, child_id array<string>, source array<string>, parent_index array<int>, child_index array<int>, length array<int>, term array<string>, blocks array<int>, df array<int>, doc binary, tf binary, wide boolean, range binary, postings array<int>, block_tf array<int>, block_length array<int>"


def _shard(rows: pa.Table, word: re.Pattern, seed: bool) -> pa.RecordBatch:
    """Children -> their shard."""
    said = [word.findall(t or "") for t in rows["_t"].to_pylist()]
    length = np.fromiter(map(len, said), np.int32, len(said))
    number: dict[str, int] = {}
    flat = np.fromiter((number.setdefault(t, len(number)) for ts in said for t in ts), np.int64, int(length.sum()))
    pair, tf = np.unique(flat * len(said) + np.repeat(np.arange(len(said)), length), return_counts=True)
    term, doc = pair // max(1, len(said)), pair % max(1, len(said))
    df = np.bincount(term, minlength=len(number))
    within = doc // RANGE
    begins = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (within[1:] != within[:-1])])) if len(doc) else np.zeros(0, np.int64)
    wide = bool(len(tf) and tf.max() > 255)
    columns = [pa.array([seed]), pa.array([rows["child_id"][0].as_py()], pa.string())]
    columns += [pa.array([rows[c].to_pylist()], pa.list_(kind)) for c, kind in (("child_id", pa.string()), ("source", pa.string()), ("parent_index", pa.int32()), ("child_index", pa.int32()))]
    ints = lambda v: pa.array([np.asarray(v, np.int32)], pa.list_(pa.int32()))
    columns += [ints(length), pa.array([list(number)], pa.list_(pa.string())), ints(np.bincount(term[begins], minlength=len(number))), ints(df)]
    columns += [pa.array([(doc % RANGE).astype(np.uint8).tobytes()]), pa.array([tf.astype(np.uint32 if wide else np.uint8).tobytes()]), pa.array([wide])]
    columns += [pa.array([within[begins].astype(np.uint16).tobytes()]), ints(np.diff(begins, append=len(doc))), ints(np.maximum.reduceat(tf, begins) if len(begins) else tf), ints(np.minimum.reduceat(length[doc], begins) if len(begins) else doc)]
    return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in SHARDS.split(", ")])


def build(children: DataFrame, shard: int | None = None) -> DataFrame:
    """The shards of the children (``child_id, source, parent_index, child_index, child_text``), a written table."""
    most = min(shard or SHARD, 1 << 16)
    rows = children.select("child_id", *ORDER, F.lower("child_text").alias("_t"))

    def run(batches):
        word, kept, size, made = re.compile(TOKEN_WORD), [], 0, 0
        for batch in (b.slice(i, most) for b in batches for i in range(0, b.num_rows, most)):
            while size + batch.num_rows >= most:
                kept.append(batch.slice(0, most - size))
                batch = batch.slice(most - size)
                yield _shard(pa.Table.from_batches(kept), word, made < SEEDS)
                kept, size, made = [], 0, made + 1
            if batch.num_rows:
                kept.append(batch)
                size += batch.num_rows
        if size:
            yield _shard(pa.Table.from_batches(kept), word, made < SEEDS)

    return stored(rows.mapInArrow(run, SHARDS), "shards", GROUP_BYTES)


def statistics(shards: DataFrame) -> DataFrame:
    """``term, df, idf, avg_len`` over the children of all shards: the same as ``lexical.fit`` counts."""
    df = shards.select(F.explode(F.arrays_zip("term", "df")).alias("t")).groupBy("t.term").agg(F.sum("t.df").alias("df"))
    total = F.aggregate("length", F.lit(0).cast("long"), lambda a, x: a + x)
    stats = shards.select(F.size("length").alias("n"), total.alias("length")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.coalesce(F.sum("length"), F.lit(0)) / F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1))).alias("avg_len"))
    return weighed(df, stats)


def _counted(dim: int):
    """Batches of shards -> blocks of at most ROWS children for ``vector.hash_search``: a bucket's count is the sum of its terms' frequencies."""

    def run(batches):
        bucket = Buckets(dim)
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r] for name in batch.schema.names}
                ints = lambda name: row[name].values.to_numpy()  # noqa: B023, E731
                terms, postings = row["term"].values.to_pylist(), ints("postings")
                known = bucket.find(terms)
                places = np.fromiter((known[t] for t in terms), np.int64, len(terms))
                doc = np.repeat(np.frombuffer(row["range"].as_py(), np.uint16) * RANGE, postings) + np.frombuffer(row["doc"].as_py(), np.uint8)
                place = np.repeat(np.repeat(places, ints("blocks")), postings)
                tf = np.frombuffer(row["tf"].as_py(), np.uint32 if row["wide"].as_py() else np.uint8)
                by_doc = np.argsort(doc, kind="stable")
                doc, place, tf = doc[by_doc].astype(np.int64), place[by_doc], tf[by_doc]
                keys = pa.RecordBatch.from_arrays([row[c].values for c in ("child_id", *ORDER)], ["child_id", *ORDER])
                order = in_order(keys)
                for first in range(0, keys.num_rows, ROWS):
                    some = keys.slice(first, ROWS)
                    a, b = np.searchsorted(doc, [first, first + some.num_rows])
                    counts = np.bincount((doc[a:b] - first) * dim + place[a:b], tf[a:b], some.num_rows * dim)
                    yield counts.reshape(some.num_rows, dim), order[first : first + some.num_rows], some

    return run


def hash_top_n(shards: DataFrame, queries: DataFrame, n: int, min_sim: float, dim: int, qid: str = "qid", text: str = "question") -> DataFrame:
    """``vector.hash_top_n`` of the children in the shards: their tokens are counted there, so no text is read or cut into tokens again."""
    rows = shards.select("child_id", *ORDER, "term", "blocks", "doc", "tf", "wide", "range", "postings")
    with few_at_a_time(shards.sparkSession, AT_A_TIME):
        found = stored(hash_search(rows, _counted(dim), queries, n, min_sim, dim, qid, text, written=True), "found")
    return ranked_children(found, n, qid, "cosine")


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of several spans, one after another."""
    return np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)


class Postings:
    """A shard as a search of it wants it."""

    def __init__(self, row: dict, asked: pa.Array, mean: float, p: Retrieval):
        """``asked``: the terms of all questions; ``at`` gives the number of each in this shard, or -1."""
        ints = lambda name: row[name].values.to_numpy().astype(np.int64)
        self.at = pc.fill_null(pc.index_in(asked, value_set=row["term"].values), -1).to_numpy(zero_copy_only=False)
        length, self.df, self.blocks, self.postings = ints("length"), ints("df"), ints("blocks"), ints("postings")
        self.size, self.k1 = len(length), p.k1
        self.first_block, self.first = np.cumsum(self.blocks) - self.blocks, np.cumsum(self.postings) - self.postings
        self.doc = np.frombuffer(row["doc"].as_py(), np.uint8)
        self.tf = np.frombuffer(row["tf"].as_py(), np.uint32 if row["wide"].as_py() else np.uint8)
        self.range = np.frombuffer(row["range"].as_py(), np.uint16).astype(np.int64)
        slower = lambda n: p.k1 * (1 - p.b + p.b * n / mean)
        self.norm = slower(length)
        self.bound = self.share(ints("block_tf"), slower(ints("block_length")))

    def share(self, tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return tf * (self.k1 + 1) / (tf + norm)

    def best(self, terms: np.ndarray, weights: np.ndarray, n: int, floor: float | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Children that may be among the n best of a question, with their whole scores, and how many postings were scored.
        ``floor``: what the n-th best has elsewhere; without one, only the children of the ranges with the greatest bounds."""
        order = np.argsort(-weights, kind="stable")
        terms, weights = terms[order], weights[order]
        groups = min(GROUPS, len(terms))
        blocks, number = _spans(self.first_block[terms], self.blocks[terms]), np.repeat(np.arange(len(terms)) * groups // len(terms), self.blocks[terms])
        ranges, n_ranges, weight = self.range[blocks], -(-self.size // RANGE), np.repeat(weights, self.blocks[terms])
        bounds = weight * self.bound[blocks]
        if floor is None:
            most = np.bincount(ranges, bounds, minlength=n_ranges)
            opened = np.zeros(n_ranges, bool)
            opened[np.argsort(-most, kind="stable")[: 1 + 2 * n // RANGE]] = True
            here = opened[ranges]
            acc, scored = self._added(np.zeros(self.size), blocks[here], weight[here])
            found = np.flatnonzero(acc)
            return found, acc[found], scored
        left = np.zeros((groups + 1, n_ranges))  # what the groups of terms from each on can add, by range
        left[:-1] = np.cumsum(np.bincount(number * n_ranges + ranges, bounds, minlength=groups * n_ranges).reshape(-1, n_ranges)[::-1], 0)[::-1]
        opened = (left[0] > 0) & (left[0] + NOISE >= floor)
        if not opened.any():
            return np.zeros(0, np.int64), np.zeros(0), 0
        return self._lifted(opened, blocks, number, ranges, weight, left, floor)

    def _lifted(self, opened, blocks, number, ranges, weight, left, floor) -> tuple[np.ndarray, np.ndarray, int]:
        """Children of the opened ranges that can reach the floor, with their whole scores, and how many postings were scored."""
        here = opened[ranges]
        blocks, number, ranges, weight = blocks[here], number[here], ranges[here], weight[here]
        all_ranges, which = np.arange(len(opened)), np.arange(self.size) // RANGE
        # a child that is in none of a range's first groups can't get there by the others alone
        first = left[number, ranges] + NOISE >= floor
        acc, scored = self._added(np.zeros(self.size), blocks[first], weight[first])
        until = (left[:-1] + NOISE >= floor).sum(0)
        alive = (acc > 0) & (acc + left[until, all_ranges][which] + NOISE >= floor)
        blocks, ranges, weight = blocks[~first], ranges[~first], weight[~first]
        now = (np.bincount(which[alive], minlength=len(opened)) > 0)[ranges]
        acc, some = self._added(acc, blocks[now], weight[now], alive)
        scored += some
        alive &= acc + NOISE >= floor
        found = np.flatnonzero(alive)
        return found, acc[found], scored

    def _added(self, acc: np.ndarray, blocks: np.ndarray, weight: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, int]:
        """``acc`` and the weighted scores of the blocks' postings, or of those of some children; and how many they were."""
        size = self.postings[blocks]
        place = _spans(self.first[blocks], size)
        doc, w = np.repeat(self.range[blocks] * RANGE, size) + self.doc[place], np.repeat(weight, size)
        if only is not None:
            keep = only[doc]
            place, doc, w = place[keep], doc[keep], w[keep]
        return acc + np.bincount(doc, w * self.share(self.tf[place].astype(float), self.norm[doc]), minlength=self.size), len(place)


def search(shards: DataFrame, terms: DataFrame, queries: DataFrame, n: int, params: Retrieval | None = None, qid: str = "qid", text: str = "question", tally=None) -> DataFrame:
    """Keyword channel: ``qid, rank, child_id, score, score_kind`` of the n best children with a positive score; ties go by source, parent and child order.

    ``terms``: the statistics (of ``statistics``, or kept by a store).  ``tally``: two accumulators, for the postings that were scored, and all postings of the questions' terms.
    """
    p = params or Retrieval()
    spark = shards.sparkSession
    asked = queries.select(F.col(qid).alias("_q"), F.explode(tokens(F.col(text))).alias("term")).groupBy("_q", "term").agg(F.count("*").alias("qf"))
    weights = stored(asked.join(terms, "term").select("_q", "term", (F.col("qf") * F.col("idf")).alias("w"), "avg_len"), "weights")
    passes = max(1, -(-weights.count() // WEIGHTS))
    # only row groups with such shards are read for the seeds, and no more shards than the seeds are dealt out
    seeds = shards.filter("seed")
    seeds = seeds.filter(F.col("name").isin([r.name for r in seeds.select("name").limit(SEEDS).collect()]))
    qtype = queries.schema[qid].dataType.simpleString()
    found = None
    for number in range(passes):
        part = weights.filter(F.pmod(F.xxhash64("_q"), F.lit(passes)) == number).toArrow().combine_chunks()
        one = lambda name: part.column(name).combine_chunks() if part.num_rows else pa.array([], part.schema.field(name).type)  # noqa: B023, E731
        ids, words = pc.unique(one("_q")), pc.unique(one("term"))
        question = pc.index_in(one("_q"), value_set=ids).to_numpy(zero_copy_only=False).astype(np.int64)
        term = pc.index_in(one("term"), value_set=words).to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(question, kind="stable")
        begin = np.searchsorted(question[order], np.arange(len(ids) + 1))
        mean = part.column("avg_len")[0].as_py() if part.num_rows else 1.0
        sent = spark.sparkContext.broadcast((ids, words, begin, term[order], one("w").to_numpy()[order], max(mean, 1.0)))

        def run(batches, sent=sent, floor=None):
            ids, words, begin, term, weight, mean = sent.value
            tops = np.full((len(ids), n), -np.inf)  # the n best of each question so far, ascending
            if floor is not None:
                tops[:] = floor.value[:, None]
            for batch in batches:
                for r in range(batch.num_rows):
                    row = {name: batch.column(name)[r] for name in batch.schema.names}
                    shard = Postings(row, words, mean, p)
                    keys = {c: row[c].values for c in ORDER}
                    order = np.empty(shard.size, np.int64)
                    order[pc.sort_indices(pa.table(keys), [(c, "ascending") for c in ORDER]).to_numpy()] = np.arange(len(order))
                    docs, cols, scores, scored, every = [], [], [], 0, 0
                    here = shard.at[term]
                    for q in range(len(ids)):
                        own = here[begin[q] : begin[q + 1]]
                        known = own >= 0
                        if not known.any():
                            continue
                        doc, score, some = shard.best(own[known], weight[begin[q] : begin[q + 1]][known], n, None if floor is None else tops[q, 0])
                        scored, every = scored + some, every + int(shard.df[own[known]].sum())
                        score = np.round(score, 6)
                        keep = np.flatnonzero((score > 0) & (score >= tops[q, 0]))
                        keep = keep[np.lexsort((order[doc[keep]], -score[keep]))[:n]]
                        if len(keep):
                            tops[q] = np.sort(np.concatenate([tops[q], score[keep]]))[-n:]
                            docs.append(doc[keep])
                            cols.append(np.full(len(keep), q))
                            scores.append(score[keep])
                    if tally is not None:
                        tally[0].add(scored)
                        tally[1].add(0 if floor is None else every)
                    if floor is not None and docs:
                        take = pa.array(np.concatenate(docs))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(cols))), *(row[c].values.take(take) for c in ("child_id", *ORDER)), pa.array(np.concatenate(scores))], ["_q", "child_id", *ORDER, "score"])
            if floor is None:
                asker, place = np.nonzero(np.isfinite(tops))
                yield pa.RecordBatch.from_arrays([pa.array(asker), pa.array(tops[asker, place])], ["q", "score"])

        # what the best ranges of a few shards have together is to be beaten in all
        some = seeds.repartition(SEEDS).mapInArrow(run, "q long, score double")
        with few_at_a_time(spark, AT_A_TIME):
            nth = some.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("r") == n).select("q", "score").toArrow()  # a row for each question
        floor = np.full(len(ids), -np.inf)
        floor[nth.column("q").to_numpy()] = nth.column("score").to_numpy()
        run = partial(run, floor=spark.sparkContext.broadcast(floor))

        got = shards.mapInArrow(run, f"_q {qtype}, child_id string, source string, parent_index int, child_index int, score double")
        with few_at_a_time(spark, AT_A_TIME):
            got = stored(got, "found")
        found = got if found is None else found.unionByName(got)
    return ranked_children(found, n, qid, "bm25")
