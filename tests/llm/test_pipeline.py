import os
import random

import numpy as np
from helpers import docs, prose
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import shingle_sets, simhash
from tessera.llm.common import stored


def test_stages_in_order(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, sf)
        if name != "packing":
            assert out.columns == table.columns
            rows = out.collect()
            counts.append(len(rows))
            table = spark.createDataFrame(rows, table.schema)
    assert counts == sorted(counts, reverse=True) and counts[-1] > 100
    pieces = out.collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in rows}


def test_one_of_each_group_stays(spark):
    base = prose(1, 400)
    texts = [base, base + " end", prose(2, 100), base, None, "", prose(3, 90), prose(2, 100)]
    table = docs(spark, texts, ids=[5, 3, 2, 9, 7, 8, None, None]).selectExpr("*", "1 as fp", "2 as _key")
    kept = simhash.keep_one(table, shingle=5)
    assert kept.columns == table.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([3, 2, 7, None], key=repr)
    assert simhash.keep_one(docs(spark, [])).count() == 0


def test_every_stage_takes_awkward_rows(spark):
    sf = "/root/testdata/sf0.001"
    odd = docs(spark, [None, "", prose(4, 20_000), "x", "x"], lang=None, ids=[None, 1, 2, 3, 3]).selectExpr("doc_id", "text", "lang", "source", "cast(null as bigint) as n_chars")
    for table in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table, sf).collect()


def test_every_stage_keeps_other_columns(spark):
    sf = "/root/testdata/sf0.001"
    names = ["_row", "kept", "score", "fp", "id", "h", "n", "node", "digest", "_id", "_h", "label", "_m"]
    table = spark.read.parquet(f"{sf}/documents.parquet").limit(60).withColumns({n: F.concat(F.lit(n), "doc_id") for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, sf)
        assert out.dtypes == table.dtypes, name
        assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, table, sf).count() >= 60


def _shingles(text):
    words = text.lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def test_repeated_rows_leave_one(spark):
    texts = [prose(1, 80), prose(1, 80), prose(2, 80), prose(2, 80) + " more", prose(2, 80), None, None]
    rows = corpus_pipeline.near_dedup(spark, docs(spark, texts, ids=[4, 4, 6, 5, 6, None, None]), None).collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted([(4, texts[0]), (5, texts[3]), (None, None)], key=repr)


def test_near_duplicates_match_brute_force(spark):
    rng, texts = random.Random(8), []
    for n in range(40):  # words changed at distances that give similarities from 0.6 to 0.97
        words = prose(1000 + n, rng.randrange(30, 400)).split()
        texts.append(" ".join(words))
        for share in (0.01, 0.02, 0.03, 0.06):
            texts.append("\n".join(f"new{rng.random()}" if rng.random() < share else w for w in words))
    crowd = prose(7, 120).split()
    for n in range(150):  # near copies of one text, and texts that share its last words only
        at = rng.randrange(120)
        texts.append(" ".join([*crowd[:at], f"odd{n}", *crowd[at + 1 :]]))
        texts.append(prose(5000 + n, 60) + " " + " ".join(crowd[60:]))
    rng.shuffle(texts)
    sets = [_shingles(t) for t in texts]
    label, similar = list(range(len(texts))), []
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                similar.append((j, i, shared / (len(sets[i]) + len(sets[j]) - shared)))
    for low in (0.8, 0.85, 0.9):
        assert sum(low <= x < low + 0.05 for _, _, x in similar) >= 10
    while True:
        was = list(label)
        for a, b, _ in similar:
            label[a] = label[b] = min(label[a], label[b])
        if was == label:
            break
    kept = corpus_pipeline.near_dedup(spark, docs(spark, texts), None)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))


def test_near_duplicates_with_awkward_rows(spark):
    base = prose(1, 400)
    texts = [base, base + " end", prose(2, 100), base, None, "", prose(3, 90), prose(2, 100), "a b", "A  b", "a c"]
    table = docs(spark, texts, ids=[5, 3, 2, 9, 7, 8, None, None, 20, 21, 22]).selectExpr("*", "1 as _set", "2 as _key")
    kept = corpus_pipeline.near_dedup(spark, table, None)
    assert kept.columns == table.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([3, 2, 7, None, 20, 22], key=repr)
    assert corpus_pipeline.near_dedup(spark, docs(spark, []), None).count() == 0


def test_parities_lose_no_pair():
    rng = np.random.default_rng(3)
    for size in (0, 1, 5, 64, 65, 300, 5000):
        for other in (0, 1, size // 5, size):
            x = np.unique(rng.integers(0, 1 << 63, size + other, dtype=np.uint64))
            y = np.concatenate([x[:size], rng.integers(0, 1 << 63, other // 2, dtype=np.uint64)])
            apart = len(np.setxor1d(x, y))
            got = shingle_sets.least_apart(shingle_sets.parities(x), shingle_sets.parities(np.unique(y)))
            assert got <= apart and (size < 300 or not apart or got > apart / 4)


def test_crowds_make_few_sets_again(spark, monkeypatch):
    monkeypatch.setattr(shingle_sets, "SAMPLE", 1)  # nothing is known to be common, as of most shingles of a large table
    base, said, texts = prose(7, 200).split(), prose(8, 60), []
    for n in range(300):  # near copies of one text, and texts that share a passage
        rng = random.Random(n)
        texts.append(" ".join(f"odd{n}x{i}" if rng.random() < 0.02 else w for i, w in enumerate(base)))
        texts.append(f"{prose(9000 + n, 40)} {said} {prose(9500 + n, 40)}")
    asked, stored = [], shingle_sets.stored
    monkeypatch.setattr(shingle_sets, "stored", lambda df, name: (asked.append((name, stored(df, name))), asked[-1][1])[1])
    counts, drop = {}, shingle_sets.drop

    def counted(table):
        for name, t in asked:
            if t is table:
                counts[name] = counts.get(name, 0) + table.count()
        drop(table)

    monkeypatch.setattr(shingle_sets, "drop", counted)
    sets = [_shingles(t) for t in texts]
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(spark, texts), None).collect()}
    label, rest = {}, set(range(len(texts)))
    while rest:
        todo = [first := min(rest)]
        rest.discard(first)
        for i in todo:
            label[i] = first
            close = {j for j in rest if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))}
            rest -= close
            todo += sorted(close)
    assert kept == set(label.values())
    assert counts["asked"] < len(texts)  # sets are made again for few, not for all that share a passage


def test_a_crowd_is_linked_by_hubs(spark, monkeypatch):
    base, texts = prose(11, 150).split(), []
    for n in range(500):  # copies with words changed, some shorter: many pairs of them aren't similar, but most link to the least changed ones
        rng, words = random.Random(n), list(base)
        for at in rng.sample(range(150), rng.randrange(7)):
            words[at] = f"odd{n}x{at}"
        if n % 10 == 0:
            for at in rng.sample(range(140), 8):
                del words[at]
        texts.append(" ".join(words))
    counts, stored = [], shingle_sets.stored

    def counted(df, name):
        table = stored(df, name)
        if name == "pairs":
            counts.append(table.count())
        return table

    monkeypatch.setattr(shingle_sets, "stored", counted)
    sets = [_shingles(t) for t in texts]
    label, rest = {}, set(range(len(texts)))
    while rest:
        todo = [first := min(rest)]
        rest.discard(first)
        for i in todo:
            label[i] = first
            close = {j for j in rest if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))}
            rest -= close
            todo += sorted(close)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs(spark, texts), None).collect()}
    assert kept == set(label.values())
    assert 20 < len(kept) < 300 and sum(counts) < 8 * len(set(texts))


def test_tables_in_between_have_no_mark_of_success(spark):
    """Each mark is two processes of the driver, which count with all of its memory while they start."""
    table = stored(spark.range(10), "numbers")
    folder = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert table.count() == 10 and not os.path.exists(f"{folder}/_SUCCESS") and not os.path.exists(f"{folder}/._SUCCESS.crc")
