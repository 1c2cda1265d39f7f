"""Shards of postings: statistics, hot terms, skipping."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

from tessera import config
from tessera.operators import lexical, postings, vector
from tessera.plans import retrieve
from tessera.sources.tables import few_at_a_time, stored

KIND = "child_id string, source string, parent_index int, child_index int, child_text string"


def rows_of(shards):
    """(child, term) -> frequency, decoded."""
    out = {}
    for s in shards.collect():
        width = 4 if s.wide else 1
        ranges = iter(int.from_bytes(s.range[i : i + 2], "little") for i in range(0, len(s.range), 2))
        sizes, postings_of, at = iter(s.postings), {}, 0
        for term, blocks, df in zip(s.term, s.blocks, s.df):
            for _ in range(blocks):
                first = next(ranges) * postings.RANGE
                for _ in range(next(sizes)):
                    postings_of[s.child_id[first + s.doc[at]], term] = int.from_bytes(s.tf[width * at : width * (at + 1)], "little")
                    at += 1
            assert df == sum(t == term for _, t in postings_of)
        out |= postings_of
    return out


def test_shards_hold_every_posting_and_a_hot_term_is_in_all(spark):
    rng = random.Random(6)
    texts = [" ".join(["hot", *rng.choices([f"w{i}" for i in range(60)], k=rng.randrange(9))]) for _ in range(500)] + ["", None, "same " * 700]
    children = spark.createDataFrame([(f"c{i}", "s", i, 0, t) for i, t in enumerate(texts)], KIND).repartition(4)
    shards = postings.build(children, shard=64)
    got = rows_of(shards)
    want = {(f"c{i}", w): (t or "").split().count(w) for i, t in enumerate(texts) for w in set((t or "").split())}
    assert got == want
    assert sum("hot" in s.term for s in shards.collect()) >= 8 and max(len(s.length) for s in shards.collect()) <= 64
    kept = {tuple(r) for r in postings.statistics(shards).collect()}
    assert kept == {tuple(r) for r in lexical.fit(children).terms.collect()}
    asked = spark.createDataFrame([(1, "hot w3"), (2, "same"), (3, "nothing"), (4, ""), (5, None)], "qid int, question string")
    found = postings.search(shards, postings.statistics(shards), asked, 3).collect()
    assert [r.child_id for r in found if r.qid == 2] == ["c502"] and {r.qid for r in found} == {1, 2}
    empty = postings.build(children.limit(0))
    assert postings.search(empty, postings.statistics(empty), asked, 3).count() == 0


def test_few_postings_are_scored(spark):
    sf = "/root/testdata/sf0.1"
    c = retrieve.corpus(spark.read.parquet(f"{sf}/documents.parquet"))
    asked = retrieve.questions(spark.read.parquet(f"{sf}/benchmark.parquet"))
    shards = postings.build(c.children)
    tally = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    assert postings.search(shards, postings.statistics(shards), asked, config.Retrieval().candidates, tally=tally).count() > 0
    assert tally[0].value < 0.22 * tally[1].value


def test_a_task_never_holds_all_shards_of_its_files(spark, monkeypatch):
    texts = [("t%d" % i, "s", i, 0, " ".join(f"w{(i * 7 + j) % 300}" for j in range(40))) for i in range(640)]
    children = spark.createDataFrame(texts, KIND).coalesce(1)
    asked = spark.createDataFrame([(1, "w1 w2 w3")], "qid int, question string")
    shards = postings.build(children)
    want = [tuple(r) for r in postings.search(shards, postings.statistics(shards), asked, 5).collect()]
    bounds = []
    monkeypatch.setattr(postings, "GROUP_BYTES", 1 << 10)
    monkeypatch.setattr(postings, "few_at_a_time", lambda session, rows: bounds.append(rows) or few_at_a_time(session, rows))
    shards = postings.build(children, shard=16)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in shards.inputFiles()]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(groups) == 40 and max(groups) <= 2
    assert [tuple(r) for r in postings.search(shards, postings.statistics(shards), asked, 5).collect()] == want
    assert len(bounds) == 2 and max(bounds) <= 4  # of the shards that tell the floor, and of all
    with few_at_a_time(spark, 2):
        sizes = stored(shards.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long"), "sizes")
    assert sizes.agg({"n": "max"}).first()[0] <= 2


def test_statistics_take_one_pass(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    texts = [("a", "s", 0, 0, "x y x"), ("b", "s", 1, 0, "y 漢字"), ("c", "s", 2, 0, "!?"), ("d", "s", 3, 0, None)]
    children = spark.createDataFrame(texts, KIND)
    got = {tuple(r) for r in lexical.statistics(children.mapInArrow(counted, KIND)).collect()}
    assert seen.value == len(texts) and got == {tuple(r) for r in lexical.fit(children).terms.collect()} and len(got) == 4
    assert lexical.statistics(children.limit(0)).count() == 0


def test_the_vector_channel_counts_tokens_in_the_shards(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(90)], k=rng.randrange(30))) for _ in range(700)] + ["", None, "same " * 700, "w1 " * 300 + "w2"]
    children = spark.createDataFrame([(f"c{i}", f"s{i % 7}", i, 0, t) for i, t in enumerate(texts)], KIND).repartition(3)
    asked = spark.createDataFrame([(i, " ".join(rng.choices([f"w{i}" for i in range(95)], k=9))) for i in range(20)] + [(90, "same"), (91, ""), (92, None)], "qid int, question string")
    shards = postings.build(children, shard=64)
    for dim, least in ((16, 0.35), (1536, 0.2), (16, 0.0)):
        want = {tuple(r) for r in vector.hash_top_n(children, asked, 5, least, dim).collect()}
        assert {tuple(r) for r in postings.hash_top_n(shards, asked, 5, least, dim).collect()} == want
    # both channels from one table of shards: the texts are read once, to make it
    p = config.Retrieval(min_sim=0.2)
    corpus = retrieve.Corpus(None, stored(children, "children"))
    found, words = retrieve.both_channels(corpus, asked, p)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in retrieve.vector_hits(corpus, asked, p).collect()}
    assert {tuple(r) for r in words.collect()} == {tuple(r) for r in retrieve.keyword_hits(corpus, asked, p).collect()}
    assert postings.hash_top_n(postings.build(children.limit(0)), asked, 5, 0.35, 16).count() == 0
