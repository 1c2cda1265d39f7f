import random

import numpy as np
import xxhash
from helpers import docs, given, prose

from tessera.llm import simhash
from tessera.llm.components import components
from tessera.llm.queries import op7_simhash_near_dedup


def slow_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(pairs):
    """{row: component} of (id, fingerprint) pairs."""
    label = [i for i, _ in pairs]
    while True:
        new = [min(l2 for (_, g), l2 in zip(pairs, label) if (f ^ g).bit_count() <= 3) for _, f in pairs]
        if new == label:
            return label
        label = new


def test_query_matches_brute_force(spark, sf):
    rows = given(sf, "documents")
    got = {r.doc_id: r for r in op7_simhash_near_dedup(spark, sf).collect()}
    pairs = [(r["doc_id"], slow_fingerprint(r["text"])) for r in rows]
    want = slow_components(pairs)
    assert len(got) == len(rows)
    for (i, f), c in zip(pairs, want):
        assert (got[i].fingerprint, got[i].component_id) == (f"{f:016x}", c)


def test_pairs_within_three_bits_share_an_anchor():
    rng = random.Random(5)
    for _ in range(2000):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << b
        keys, index, home = simhash.anchors(np.array([x, y], np.uint64))
        at = [{int(k) for k, i in zip(keys, index) if i == n} for n in (0, 1)]
        homes = {int(k) for k, i, h in zip(keys, index, home) if h and i == 0}
        assert homes & at[1]


def test_crowded_anchor_is_split_and_loses_no_link(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = list({base ^ (1 << rng.randrange(32)) ^ (1 << rng.randrange(64)) for _ in range(300)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame(list(enumerate(signed)), "node long, fp long")
    for block in (20, 4096):
        got = {r.node: r.component for r in components(simhash.link(df, block=block)).collect()}
        assert [got.get(i, i) for i in range(len(fps))] == slow_components(list(enumerate(fps)))


def test_awkward_rows(spark):
    long = prose(1, 30_000)
    texts = [None, "", "one", "One", long, long, " \n\t", "x y"]
    table = docs(spark, texts, ids=[0, 1, 2, 3, 4, 4, None, 7]).selectExpr("*", "1 as fp", "'z' as component_id")
    rows = simhash.near_duplicates(table).collect()
    assert len(rows) == 8
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.fp, r.component_id))
    assert by[0] == by[1] == by[None] == [(0, 0)]
    assert by[2][0][1] == by[3][0][1] == 2 and len(set(by[4])) == 1
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    only = simhash.near_duplicates(docs(spark, ["a b c"], ids=[None])).collect()
    assert only[0].component_id is None


def test_components_of_a_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    hub = [(7, i) for i in range(1000, 1500)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path + hub + [(5, 5)], "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 7 for i in range(1000, 1500)) and 5 not in got


def test_texts_without_ids_stay_apart(spark):
    texts = [prose(1, 50), prose(2, 50), prose(2, 50), prose(3, 50)]
    rows = simhash.near_duplicates(docs(spark, texts, ids=[None, None, 9, 3])).collect()
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=repr) == sorted([(None, None), (None, 9), (9, 9), (3, 3)], key=repr)
