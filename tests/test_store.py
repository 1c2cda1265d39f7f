"""The log of segments: merge on read, racing writers, compaction, statistics kept up with the log."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from oracle import compare
from tessera import oracles, queries
from tessera.operators import chunk, lexical
from tessera.operators.store import Store
from tessera.streaming import incremental

DOCS = "source string, text string, label string"


def documents(spark, texts):
    return spark.createDataFrame([(s, t, "") for s, t in texts.items()], DOCS)


def put(store, texts, gone=()):
    spark = store.spark
    docs = documents(spark, texts)
    parents = chunk.parents(docs, label="label")
    ledger = docs.select("source", F.sha2("text", 256).alias("fingerprint"), F.current_timestamp().alias("indexed_at"))
    return store.sync(ledger, parents, chunk.children(parents), spark.createDataFrame([(g,) for g in gone], "source string"))


def state(store):
    return {r.source: r.parent_text for r in store.read("parents").collect()}


def check_terms(store):
    kept = {r.term: (r.df, round(r.idf, 9), round(r.avg_len, 9)) for r in store.terms().collect()}
    counted = {r.term: (r.df, round(r.idf, 9), round(r.avg_len, 9)) for r in lexical.fit(store.read("children")).terms.collect()}
    assert kept == counted


def test_random_history_equals_a_dictionary(spark, tmp_path):
    rng = random.Random(4)
    store, want = Store(spark, f"file://{tmp_path}/s", fan=3), {}
    for step in range(6):
        texts = {f"/d/{rng.randrange(25)}": f"[word{rng.randrange(6)} text{step}] {rng.randrange(9)}" for _ in range(rng.choice((0, 1, 8)))}
        gone = {f"/d/{rng.randrange(25)}" for _ in range(rng.randrange(4))} - set(texts)
        put(store, texts, gone)
        want = {s: t for s, t in want.items() if s not in gone} | texts
        got = state(store)
        assert set(got) == set(want) and all(got[s].endswith(t) for s, t in want.items())
    assert {r.source for r in store.read("ledger").collect()} == set(want)
    check_terms(store)
    before, segments = state(store), len(store.at().segments)
    assert segments < 6  # some were merged on the way
    put(store, {})
    assert store.compact(whole=True) and state(store) == before and len(store.at().segments) == 1
    check_terms(store)
    assert store.vacuum(keep=1, older_than=0) > 0 and state(store) == before
    some = next(iter(before))
    assert store.of_source("parents", some).count() == 1 and store.of_source("parents", "/nobody").count() == 0
    one = store.read("parents").first()
    assert store.parent(one.parent_id).first().source == one.source


def test_a_batch_writes_what_it_brings_and_a_lookup_reads_little(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    many = spark.range(100_000).select(F.format_string("/d/%06d", "id").alias("source"), F.concat(F.lit("some words of text number "), F.col("id").cast("string")).alias("text"), F.lit("").alias("label"))
    assert incremental.index_batch(store, many) == {"indexed": 100_000, "skipped": 0}
    batch = spark.range(100).select(F.format_string("/d/%06d", F.col("id") * 7).alias("source"), F.lit("a new text").alias("text"), F.lit("").alias("label"))
    assert incremental.index_batch(store, batch) == {"indexed": 100, "skipped": 0}
    base, added = store.at().segments
    assert base.rows["children"] == 100_000 and added.rows["children"] == 100 and added.rows["terms"] < 500
    assert added.size < base.size / 50
    assert store.read("children").count() == 100_000 and store.of_source("parents", "/d/000007").first().parent_text.endswith("a new text")
    assert not added.may_hold("/d/090000") and store.fingerprint("/d/090000")
    check_terms(store)


def test_racing_writers_all_commit(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    put(Store(spark, path), {f"/d/{i}": f"old {i}" for i in range(6)})
    failed = []

    def write(k):
        try:
            put(Store(spark, path), {f"/d/{k}": f"by writer {k}", "/d/5": f"shared by {k}"}, [f"/d/{k + 3}"] if k < 2 else [])
        except Exception as e:  # shown below
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    store = Store(spark, path)
    got = state(store)
    assert set(got) == {"/d/0", "/d/1", "/d/2", "/d/5"} and all(got[f"/d/{k}"].endswith(f"by writer {k}") for k in range(3)) and "shared by" in got["/d/5"]
    check_terms(store)  # the changes of the shared source are counted once


def test_a_number_is_taken_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    assert store.version() is None and store.read("ledger") is None and store.initialize() == 1 == store.initialize()
    put(store, {"/d/a": "x"})
    now = store.at()
    assert not store._publish(now) and store.at() == now
    other = Store(spark, f"file://{tmp_path}/s")
    publish, tried = store._publish, []

    def slower(version):
        if not tried:
            tried.append(put(other, {"/d/b": "y", "/d/a": "newer"}))
        return publish(version)

    store._publish = slower
    assert put(store, {"/d/a": "newest"}) == now.number + 2
    assert {s: t.split()[-1] for s, t in state(store).items()} == {"/d/a": "newest", "/d/b": "y"}
    check_terms(store)


def test_compaction_yields_to_another(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", fan=100)
    for i in range(4):
        put(store, {f"/d/{i}": "x"})
    commit = store._commit

    def late(change):
        store._commit = commit
        assert store.compact(whole=True)
        return commit(change)

    store._commit = late
    assert not store.compact(whole=True) and len(state(store)) == 4


def test_without_statistics(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", statistics=False)
    put(store, {"/d/a": "x"})
    with pytest.raises(ValueError):
        store.terms()


@pytest.mark.parametrize("name", ["store_ledger", "store_terms"])
def test_merged_state_matches_sql(spark, sf, name):
    compare(spark, sf, queries.queries()[name], oracles.oracle_sql()[name])


def test_documents_of_a_batch_are_chunked_once(spark, tmp_path, monkeypatch):
    seen, chunked = spark.sparkContext.accumulator(0), incremental.chunk.parents

    def counted(docs, **options):
        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return chunked(docs.select("source", "text", "label").mapInArrow(run, "source string, text string, label string"), **options)

    monkeypatch.setattr(incremental.chunk, "parents", counted)
    store = Store(spark, str(tmp_path / "store"))
    docs = spark.createDataFrame([(str(i), f"words of {i}. " * 50, "") for i in range(5)], "source string, text string, label string")
    assert incremental.index_batch(store, docs)["indexed"] == 5
    assert seen.value == 5 and store.read("children").count() > 5 and {r.source for r in store.read("parents").collect()} == {str(i) for i in range(5)}
