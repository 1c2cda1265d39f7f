"""The approximate vector index against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tessera import queries
from tessera.operators import ann, vector

KIND = "vec_id long, embedding array<float>, list string"


def recall(exact, got):
    want = {}
    for r in exact:
        want.setdefault(r.qid, set()).add(r.vec_id)
    found = {}
    for r in got:
        found.setdefault(r.qid, set()).add(r.vec_id)
    return sum(len(w & found.get(q, set())) for q, w in want.items()) / sum(map(len, want.values()))


def test_recall_on_the_given_table(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.vector_ann_topk(spark, sf).collect()
    exact = queries.vector_topk(spark, sf).collect()
    score = {(r.qid, r.vec_id): r.score for r in vector.top_n(spark.read.parquet(f"{sf}/embeddings.parquet"), spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid"), 2000, -1.0).collect()}
    share = np.mean([r.probed for r in got if r["rank"] == 1]) / 2000
    assert recall(exact, got) >= 0.9
    assert all(abs(r.score - score[r.qid, r.vec_id]) < 1e-6 for r in got)  # what is found has its exact score
    by_rank = {}
    for r in got:
        by_rank.setdefault(r.qid, []).append((r["rank"], -r.score, r.vec_id))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) and [x[1:] for x in sorted(v)] == sorted(x[1:] for x in v) for v in by_rank.values())


def test_clusters_with_a_hot_one(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16)) * 4
    x = np.concatenate([np.repeat(centres[:1], 1500, 0) + rng.normal(size=(1500, 16)) * 0.01, centres[rng.integers(40, size=3000)] + rng.normal(size=(3000, 16))]).astype(np.float32)
    v = spark.createDataFrame([(i, e.tolist(), "x") for i, e in enumerate(x)], KIND).repartition(4)
    model = ann.train(v, n=10)
    index = ann.build(v, model)
    asked = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    got = ann.search(index, model, asked, 10).collect()
    assert recall(vector.top_n(v, asked, 10, None).collect(), got) >= 0.9
    assert np.mean([r.probed for r in got]) < 0.7 * len(x)
    assert index.count() == len(x)
    code = index.filter("key = 7").first()
    at, codes, _ = model.coded(vector._unit(x[7:8].astype(float)))
    assert code.list == at[0] and bytes(code.code) == codes[0].tobytes()


def test_cases(spark):
    none = spark.createDataFrame([], KIND)
    model = ann.train(none)
    assert model is None and ann.search(ann.build(none, model), model, none.withColumnRenamed("vec_id", "qid"), 5).count() == 0
    odd = spark.createDataFrame([(1, [1.0, 0.0, 0.0], ""), (2, [0.9, 0.1, 0.0], ""), (3, None, ""), (None, [1.0, 0.0, 0.0], ""), (4, [], ""), (5, [0.0, 0.0, 0.0], ""), (2, [0.9, 0.1, 0.0], "")], KIND)
    model = ann.train(odd, n=3)
    index = ann.build(odd, model)
    assert sorted(r.key for r in index.collect()) == [1, 2, 2, 5]
    got = ann.search(index, model, odd.filter("vec_id = 1").withColumnRenamed("vec_id", "qid"), 3, 0.5).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == [(1, 1), (2, 2), (3, 2)]
    assert ann.search(index, model, odd.filter("vec_id = 9").withColumnRenamed("vec_id", "qid"), 3).count() == 0
