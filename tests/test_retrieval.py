import functools
import hashlib
import json
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import config, queries
from tessera.operators import answer, chunk, contain, context, embed, evaluate, fuse, index, lexical, postings, vector
from tessera.operators.store import Store
from tessera.plans import report, retrieve, trace
from tessera.sources import database
from tessera.streaming import incremental

HITS = "qid int, rank int, child_id string, parent_id string, child_text string, source string, score double, score_kind string"


WORDS = re.compile("[a-z0-9]+|[\u4e00-\u9fff]")


def ranked(children, asked, score, n, least):
    """(qid, rank, child_id, score) of the n best children, one by one."""
    out = []
    for q in asked:
        found = [(-s, c.source, c.parent_index, c.child_index, c.child_id) for c in children if (s := round(score(q, c), 6)) >= least]
        out += [(q.qid, rank + 1, f[4], -f[0]) for rank, f in enumerate(sorted(found)[:n])]
    return out


def found_by(df):
    return sorted((r.qid, r["rank"], r.child_id, r.score) for r in df.collect())


def test_keyword_search_equals_brute_force(spark, sf, monkeypatch):
    c = retrieve.corpus(spark.read.parquet(f"{sf}/documents.parquet").limit(60))
    asked = retrieve.questions(spark.read.parquet(f"{sf}/benchmark.parquet").limit(12))
    children = c.children.collect()
    said = {r.child_id: Counter(WORDS.findall(r.child_text.lower())) for r in children}
    df = Counter(t for s in said.values() for t in s)
    mean = sum(sum(s.values()) for s in said.values()) / len(said)

    def bm25(q, child):
        tf = said[child.child_id]
        weigh = lambda n: n * 2.5 / (n + 1.5 * (0.25 + 0.75 * sum(tf.values()) / mean))
        return sum(math.log(1 + (len(said) - df[t] + 0.5) / (df[t] + 0.5)) * weigh(tf[t]) for t in WORDS.findall(q.question.lower()) if t in tf)

    shards = postings.build(c.children)
    terms = postings.statistics(shards)
    want = ranked(children, asked.collect(), bm25, 5, 1e-6)
    close = lambda got: len(got) == len(want) and all(g[:3] == w[:3] and abs(g[3] - w[3]) < 3e-6 for g, w in zip(got, sorted(want), strict=True))
    assert close(found_by(postings.search(shards, terms, asked, 5)))
    for size in (7, 64):  # shards, blocks and passes change nothing, nor where statistics come from
        monkeypatch.setattr(postings, "WEIGHTS", 40)
        assert close(found_by(postings.search(postings.build(c.children, shard=size), lexical.fit(c.children).terms, asked, 5)))
    none = asked.limit(1).withColumn("question", F.lit("zzzzqq ???"))
    assert postings.search(shards, terms, none, 5).count() == 0
    assert postings.search(shards, terms, asked.limit(0), 5).count() == 0


def test_hash_search_equals_brute_force(spark, sf, monkeypatch):
    c = retrieve.corpus(spark.read.parquet(f"{sf}/documents.parquet").limit(60))
    asked = retrieve.questions(spark.read.parquet(f"{sf}/benchmark.parquet").limit(12))
    children = c.children.collect()

    @functools.cache
    def hashed(text):
        got = Counter(int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 1536 for t in WORDS.findall(text.lower()))
        norm = math.sqrt(sum(n * n for n in got.values()))
        return {k: n / norm for k, n in got.items()}

    cosine = lambda q, child: sum(w * hashed(child.child_text).get(k, 0.0) for k, w in hashed(q.question).items())
    want = sorted(ranked(children, asked.collect(), cosine, 5, 0.35))
    assert found_by(vector.hash_top_n(c.children, asked, 5, 0.35, 1536)) == want
    for name, value in (("QUERIES", 5), ("ROWS", 7), ("QUERY_BYTES", 500)):
        monkeypatch.setattr(vector, name, value)
    assert found_by(vector.hash_top_n(c.children, asked, 5, 0.35, 1536)) == want
    assert vector.hash_top_n(c.children, asked.limit(0), 5, 0.35, 1536).count() == 0


def test_rrf_and_parents(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "qid int, rank int, child_id string")
    b = spark.createDataFrame([(1, 1, "y"), (1, 2, "z"), (2, 1, "w")], "qid int, rank int, child_id string")
    got = [(r.qid, r["rank"], r.child_id) for r in fuse.rrf([a, b]).orderBy("qid", "rank").collect()]
    assert got == [(1, 1, "y"), (1, 2, "x"), (1, 3, "z"), (2, 1, "w")]
    assert fuse.rrf([a, b], weights=[1, 0]).filter("child_id = 'z'").first().score == 0
    with pytest.raises(ValueError):
        fuse.rrf([a, b], weights=[1])
    hits = spark.createDataFrame([(1, 1, "a", "p1", "", "", 0.5, "rrf"), (1, 2, "b", "p2", "", "", 0.9, "rrf"), (1, 3, "c", "p1", "", "", 0.5, "rrf"), (1, 4, "d", "p1", "", "", 0.7, "rrf")], HITS)
    assert [(r.parent_id, r.child_id) for r in fuse.best_child(hits).orderBy("rank").collect()] == [("p2", "b"), ("p1", "d")]
    assert [(r.parent_id, r.child_id) for r in fuse.best_child(hits, keep_order=True).orderBy("rank").collect()] == [("p1", "d"), ("p2", "b")]


def slow_mmr(score, vectors, k, lam):
    span = max(score) - min(score)
    rel = [(s - min(score)) / span if span else 1.0 for s in score]
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))) if np.linalg.norm(a) and np.linalg.norm(b) else 0.0
    out = []
    while len(out) < min(k, len(score)):
        values = [(-1e9 if i in out else round(lam * rel[i] - (1 - lam) * (max(cos(vectors[i], vectors[j]) for j in out) if out else 0.0), 12)) for i in range(len(score))]
        out.append(values.index(max(values)))
    return out


def test_mmr(spark, sf):
    rng = random.Random(1)
    rows, vectors = [], []
    for q in range(6):
        for i in range(12):
            rows.append((q, i + 1, f"{q}-{i}", "p", "", "", rng.choice([0.2, 0.5, rng.random()]), "rrf"))
            if i != 7:
                vectors.append((f"{q}-{i}", [rng.gauss(0, 1) for _ in range(5)]))
    v = dict(vectors)
    got = fuse.mmr(spark.createDataFrame(rows, HITS), spark.createDataFrame(vectors, "child_id string, embedding array<double>"), 5)
    have = {}
    for r in got.orderBy("qid", "rank").collect():
        have.setdefault(r.qid, []).append(r.child_id)
    for q in range(6):
        own = [r for r in rows if r[0] == q]
        want = slow_mmr([r[6] for r in own], [np.array(v.get(r[2], [0.0] * 5)) for r in own], 5, 0.7)
        assert have[q] == [own[i][2] for i in want]
    plain = fuse.mmr(spark.createDataFrame(rows, HITS), spark.createDataFrame(vectors, "child_id string, embedding array<double>"), 12, lam=1.0)
    scores = [r.score for r in plain.filter("qid = 0").orderBy("rank").collect()]
    assert scores == sorted(scores, reverse=True)
    assert queries.mmr_select(spark, sf).groupBy("qid").count().filter("count > 5").count() == 0


def test_best_scores_by_pieces(monkeypatch):
    rng, order = np.random.default_rng(7), np.random.default_rng(8).permutation(600)
    raw = np.round(rng.random((600, 9)), 3) + rng.choice([0.0, 4e-7], (600, 9))  # ties, and some by rounding
    for piece in (vector.PIECE, 40):
        monkeypatch.setattr(vector, "PIECE", piece)
        for least in (None, 0.6, 0.9995):
            best, kept = vector.Best(5, 9), []
            for i in range(0, 600, 150):
                row, col, score = best.of(raw[i : i + 150], least, order[i : i + 150])
                assert (score == np.round(raw[i + row, col], 6)).all()
                kept += zip(col.tolist(), (-score).tolist(), order[i + row].tolist(), strict=True)
            for q in range(9):
                want = sorted((-round(raw[i, q], 6), order[i]) for i in range(600) if least is None or raw[i, q] >= least)[:5]
                assert [x[1:] for x in sorted(kept) if x[0] == q][:5] == want
    assert all(len(x) == 0 for x in vector.Best(5, 0).of(np.zeros((3, 0)), 0.1, np.arange(3)))


def test_block_of_scores_is_passed_over_once():
    """what is noted beside a block of scores is small, whatever the block."""
    raw = np.random.default_rng(1).random((400, 10_000))
    best = vector.Best(20, 10_000)
    tracemalloc.start()
    try:
        best.of(raw, 0.1, np.arange(400))
        assert tracemalloc.get_traced_memory()[1] < 2 * raw.nbytes
    finally:
        tracemalloc.stop()


def test_support_reads_its_chunks_without_writing_them(spark, sf, monkeypatch):
    """one pass over the texts, and no hashing of each token in the JVM."""
    monkeypatch.setattr(retrieve, "stored", lambda *a, **b: pytest.fail("written"))
    plan = queries.support_score(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan


def test_vector_search_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = v.filter("vec_id = 1").withColumnRenamed("vec_id", "qid")
    got = {r.vec_id: r.score for r in vector.top_n(v, asked, 10, 0.0).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 5: 1.0}
    assert vector.top_n(v, asked.limit(0), 5, 0.1).count() == 0
    near = spark.createDataFrame([(1, [0.3499996, math.sqrt(1 - 0.3499996**2)]), (2, [0.35, math.sqrt(1 - 0.35**2)])], v.schema)
    assert [r.vec_id for r in vector.top_n(near, asked, 5, 0.35).collect()] == [2]


def test_embedding(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, "!!! ---"), (3, "")], "id int, t string")
    sparse = embed.hash_vectors(rows, "id", "t")
    assert sorted(round(r.weight, 6) for r in sparse.collect()) == [round(1 / math.sqrt(5), 6), round(2 / math.sqrt(5), 6)]
    assert len(embed.dense(sparse, "id").first().embedding) == 1536
    calls = embed.embed(rows, "t", lambda ts: [[float(len(t)), 1.0] for t in ts], 2)
    assert {r.id: r.embedding for r in calls.collect()} == {1: [5.0, 1.0], 2: [7.0, 1.0], 3: [0.0, 1.0]}
    with pytest.raises(Exception, match="one vector"):
        embed.embed(rows, "t", lambda ts: [[1.0] for _ in ts], 2, backoff=0).collect()
    cache = rows.filter("id = 1").select(embed.text_key(F.col("t")).alias("key"))
    assert embed.cache_misses(rows.unionAll(rows), cache, "t").count() == 2


def pack_case(spark, hits, parents, budget):
    h = spark.createDataFrame([(1, i + 1, f"c{i}", p, t, "s", 1.0 - i / 10, "rrf") for i, (p, t) in enumerate(hits)], HITS)
    p = spark.createDataFrame(parents, "parent_id string, parent_text string, heading string")
    q = spark.createDataFrame([(1, "x" * 15), (2, "none")], "qid int, question string")
    return {r.qid: r for r in context.pack(h, p, q, budget).collect()}


def test_pack_skips_and_goes_on(spark):
    parents = [("big", "b" * 900, "H"), ("small", "s" * 150, ""), ("mid", "m" * 600, None)]
    got = pack_case(spark, [("big", "c" * 30), ("mid", " "), ("gone", "z"), ("small", "t")], parents, config.Budget(context=300, system=100))
    r = got[1]
    assert [(b.ref, b.kind, b.parent_id, b.tokens) for b in r.blocks] == [(1, "child", "big", 20), (2, "parent", "small", 100)]
    assert r.dropped == 1 and r.used_tokens == 100 + 10 + 120 and r.utilization == round(230 / 300, 6)
    assert got[2].blocks == [] and got[2].used_tokens == 102
    over = pack_case(spark, [("small", "t")], parents, config.Budget(context=50, system=100))
    assert over[1].blocks == [] and over[1].used_tokens == 110


def test_prompt_and_history(spark):
    rows = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", " q1 "), (1, 2, "assistant", "a1"), (1, 3, "user", "q2"), (1, 4, "user", "q3")], "conv_id int, turn int, role string, text string")
    turns = context.turns(rows)
    assert [(r.question, r.answer) for r in turns.orderBy("turn").collect()] == [(" q1 ", "a1"), ("q2", ""), ("q3", "")]
    text = context.history_text(turns).first()
    assert text.history == "用户：q1\n助手：a1\n用户：q2\n用户：q3" and text.history_tokens == int(len(text.history) / 1.5)
    assert [r.turn for r in context.trim_history(turns, config.Budget(history=7)).orderBy("turn").collect()] == [3, 4]
    one = spark.range(1).select(F.array().cast("array<struct<ref:int,source:string,heading:string,text:string>>").alias("b"))
    assert one.select(context.render_prompt(F.col("b"), F.lit("Q"), history=F.lit(" "))).first()[0] == f"{config.SYSTEM_PROMPT}\n\n===== 参考资料 =====\n（未检索到相关资料）\n\n===== 问题 =====\nQ"
    n = lambda t, g: spark.range(1).select(context.resolve_history_tokens(F.lit(t).cast("string"), F.lit(g).cast("int"))).first()[0]
    assert (n("abcdef", 99), n("", 99), n(None, None)) == (4, 99, 0)


CITED = [
    (1, "a [1] b [2][1]"), (2, "[1,2] and [1-3]"), (3, "[1, 3-5]"), (4, "reversed [5-2], long [7-99]"), (5, "[1[2]] nested"), (6, "none [x] [] [-]"), (7, "[2024] [3,,4] [ 5]"), (8, ""), (9, "[10-12,11,2]"),
]


def test_citations(spark):
    rows = spark.createDataFrame(CITED, "case_id int, text string")
    got = {r.case_id: r.c for r in rows.select("case_id", answer.extract_citations(F.col("text")).alias("c")).collect()}
    assert got == {1: [1, 2], 2: [1, 2, 3], 3: [1, 3, 4, 5], 4: [5, 7], 5: [2], 6: [], 7: [2024, 3, 4], 8: [], 9: [10, 11, 12, 2]}


def test_answer_states(spark):
    block = "array<struct<ref:int,kind:string,parent_id:string,text:string,tokens:int,source:string,heading:string,score:double,score_kind:string>>"
    b = [(1, "parent", "p", "text one", 5, "s", "H", 1.0, "rrf"), (2, "child", "p2", "text two", 5, "s", "", 1.0, "rrf")]
    rows = [(1, b, "fine [1]", 0.9), (2, [], "x", 0.9), (3, b, "weak [1]", 0.1), (4, b, None, None), (5, b, " ", None), (6, b, "bad [3][1]", None), (7, b, "no source", None)]
    df = spark.createDataFrame(rows, f"qid int, blocks {block}, raw string, v double")
    got = {r.qid: r for r in answer.answer(df, F.col("raw"), F.col("v")).collect()}
    assert [got[i].refusal_reason for i in range(1, 8)] == [None, "no_context", "weak_support", "generator_error", "empty_answer", "invalid_citation", "not_supported"]
    assert got[1].citations[0].heading == "H" and got[1].validation.coverage == 0.5 and got[1].validation.unused_refs == [2]
    assert got[6].raw_text == "bad [3][1]" and got[6].text == config.REFUSALS["invalid_citation"] and got[2].raw_text is None
    loose = {r.qid: r for r in answer.answer(df, F.col("raw"), F.col("v"), strict=False).collect()}
    assert loose[6].refusal_reason is None and loose[7].text == "no source"
    said = df.select("qid", answer.echo(F.col("blocks")).alias("e")).collect()
    assert said[0].e == "根据检索到的资料：\n- text one（H） [1]\n- text two [2]" and said[1].e == config.ECHO_NONE
    # a heading that is a number reads like a citation
    year = spark.createDataFrame([(1, [(1, "parent", "p", "[2024] t", 5, "s", "2024", 1.0, "rrf")])], f"qid int, blocks {block}")
    assert answer.answer(year, answer.echo(F.col("blocks"))).first().refusal_reason == "invalid_citation"
    bm = spark.createDataFrame([(1, "bm25", 3.0)], "qid int, score_kind string, score double")
    with pytest.raises(Exception, match="cosine"):
        answer.support(bm, bm).collect()


def test_metrics(spark):
    anchors = "array<struct<source:string,heading_contains:string,text_contains:string>>"
    gold = spark.createDataFrame([(1, [("", "", "aa"), ("/x/f.md", "H", "")], True, True), (2, [("", "", "zz")], True, True), (3, [], False, True), (4, [("", "", "q")], True, False)], f"qid int, anchors {anchors}, answerable boolean, reviewed boolean")
    parents = spark.createDataFrame([("p1", "has aa here", "", "/y/g.md"), ("p2", "nothing", "the H", "/z/f.md"), ("p3", "nothing", "the H", "/z/g.md")], "parent_id string, parent_text string, heading string, source string")
    hits = spark.createDataFrame([(1, 1, "a", "p1", "", "", 1.0, "rrf"), (1, 2, "b", "p3", "", "", 1.0, "rrf"), (1, 3, "c", "p2", "", "", 1.0, "rrf"), (2, 1, "d", "gone", "zz", "s", 1.0, "rrf")], HITS)
    judged = evaluate.judge(hits, parents, gold)
    rows = {(r.qid, r["rank"]): r.matched for r in judged.collect()}
    assert rows == {(1, 1): [0], (1, 2): [], (1, 3): [1], (2, 1): [0]}
    items = {(r.qid, r.k): r for r in evaluate.item_metrics(judged, gold).collect()}
    assert (items[1, 1].recall, items[1, 3].recall, items[1, 3].rr) == (0.5, 1.0, 1.0) and round(items[1, 5].ndcg, 4) == 0.9197
    assert items[3, 5].ndcg == 0 and items[2, 1].hit == 1
    assert evaluate.metrics(evaluate.item_metrics(judged, gold)).filter("k = 1").first().n == 2
    assert evaluate.warnings(gold).first().warnings == ["unreviewed_items", "few_answerable", "few_unanswerable"]
    missing = {(r.qid, r.anchor): r.near for r in evaluate.check_anchors(gold, parents).collect()}
    assert set(missing) == {(2, 0), (4, 0)}
    with pytest.raises(ValueError):
        evaluate.select_items(gold.withColumn("qid", F.col("qid").cast("string")), ["1", "nope"])


def test_equal_ablations_give_equal_metrics(spark, sf):
    rows = {}
    for r in queries.ablation_metrics(spark, sf).collect():
        rows.setdefault(r.run, []).append((r.k, r.recall, r.hit_rate, r.mrr, r.ndcg))
    assert set(rows) == set(config.ABLATIONS) and sorted(rows["mmr"]) == sorted(rows["full"])


def test_prompts_stay_in_budget(spark, sf):
    got = queries.full_prompts(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/benchmark.parquet").count()
    assert all(r.used_tokens <= 6000 and r.n_blocks <= 5 for r in got)


def test_incremental_index(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    kind = "source string, text string, label string"
    first = spark.createDataFrame([("/d/a", "alpha beta", "a"), ("/d/b", "gamma", "b")], kind)
    assert incremental.index_batch(store, first) == {"indexed": 2, "skipped": 0}
    version = store.version()
    assert incremental.index_batch(store, first) == {"indexed": 0, "skipped": 2} and store.version() == version
    second = spark.createDataFrame([("/d/a", "alpha new", "a"), ("/d/c", "delta", "c")], kind)
    assert incremental.index_batch(store, second) == {"indexed": 2, "skipped": 0}
    assert {r.source: r.parent_text for r in store.read("parents").collect()} == {"/d/a": "[a] alpha new", "/d/b": "[b] gamma", "/d/c": "[c] delta"}
    assert incremental.index_batch(store, second, config.Chunking(max_child=200)) == {"indexed": 2, "skipped": 0}
    gone = index.vanished(store.read("ledger"), second, "/d")
    store.sync(store.read("ledger").limit(0), store.read("parents").limit(0), store.read("children").limit(0), gone)
    assert {r.source for r in store.read("children").collect()} == {"/d/a", "/d/c"}
    assert store.fingerprint("/d/b") is None and store.fingerprint("/d/a") and {r.source for r in store.sources("/d").collect()} == {"/d/a", "/d/c"} and store.sources("/d/a/x").count() == 0
    one = store.read("parents").filter("source = '/d/c'").select("parent_id").unionByName(spark.createDataFrame([("none",)], "parent_id string"))
    assert [r.source for r in store.parents(one).collect()] == ["/d/c"] and store.vectors(store.read("children")).count() == 0
    number = store.version()
    assert store.compact(whole=True) and store.vacuum(keep=1) == 0 and store.vacuum(keep=1, older_than=0) > 0 and store.version() == number + 1 and store.read("children").count() == 2
    assert store.initialize() == number + 1 and Store(spark, f"file://{tmp_path}/new").initialize() == 1


def test_store_survives_a_writer_that_dies(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/store")
    kind = "source string, text string, label string, version int"
    many = spark.createDataFrame([(f"/d/{i}", f"text {i}", "", 1) for i in range(30)], kind)
    incremental.index_batch(store, many)
    before, number = {tuple(r) for r in store.read("children").collect()}, store.version()
    change = spark.createDataFrame([("/d/3", "another text, and a longer one", "", 2), ("/d/3", "short", "", 3), ("/d/3", "a very long text that is out of date " * 3, "", None)], kind)

    def dies(*_):
        raise OSError("killed")

    monkeypatch.setattr(store, "_publish", dies)
    with pytest.raises(OSError):
        incremental.index_batch(store, change)
    again = Store(spark, store.path)
    assert again.version() == number and {tuple(r) for r in again.read("children").collect()} == before
    assert incremental.index_batch(again, change) == {"indexed": 1, "skipped": 0}
    texts = {r.source: r.parent_text for r in again.read("parents").collect()}
    assert len(texts) == 30 and texts["/d/3"] == "short"
    old, new = again.at(number), again.at(number + 1)
    assert new.segments[:-1] == old.segments and new.segments[-1].rows["touched"] == 1  # what was there stays as it was
    assert not again._publish(old) and again.version() == number + 1


def test_database_tables(spark):
    assert "vector(7)" in " ".join(database.ddl(7)) and len(database.ddl()) == 7
    for wrong in (lambda: database.ddl(0), lambda: database.read(spark, "jdbc:x", "other")):
        with pytest.raises(ValueError):
            wrong()
    url, driver = "jdbc:derby:memory:tessera;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows = spark.createDataFrame([(f"c{i}", "p", f"text {i}", "[0.5, 1]", i) for i in range(9)], "child_id string, parent_id string, child_text string, embedding string, child_index int")
    rows.write.format("jdbc").options(url=url, dbtable="child_chunk", driver=driver, createTableColumnTypes="child_id VARCHAR(64)").save()  # ids are comparable, as UUIDs are
    got = database.read(spark, url, "child_chunk", partitions=3, driver=driver)
    assert got.rdd.getNumPartitions() == 3 and sorted(r.child_id for r in got.filter("child_index > 5").collect()) == ["c6", "c7", "c8"]
    assert got.first().embedding == [0.5, 1.0]


DERBY = [
    "CREATE TABLE source_document (source VARCHAR(4000) PRIMARY KEY, fingerprint VARCHAR(64) NOT NULL, indexed_at TIMESTAMP)",
    "CREATE TABLE parent_chunk (parent_id VARCHAR(64) PRIMARY KEY, parent_text CLOB NOT NULL, source VARCHAR(4000) NOT NULL REFERENCES source_document(source), heading CLOB, parent_index INT, char_len INT)",
    "CREATE TABLE child_chunk (child_id VARCHAR(64) PRIMARY KEY, parent_id VARCHAR(64) NOT NULL REFERENCES parent_chunk(parent_id), child_text CLOB NOT NULL, embedding CLOB NOT NULL, child_index INT, char_start INT, char_end INT)",
]


def test_database_writes_are_one_transaction(spark):
    url, driver = "jdbc:derby:memory:written;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    database.initialize(spark, url, DERBY, driver=driver)
    database.initialize(spark, url, [], driver=driver)  # what is there stays

    def put(texts, gone, batch, spoil=None):
        docs = spark.createDataFrame(list(texts.items()), "source string, text string").withColumn("label", F.lit("x")).repartition(3)
        parents = chunk.parents(docs, label="label")
        children = chunk.children(parents).withColumn("embedding", F.array(F.lit(0.5), F.lit(1.0)).cast("array<float>"))
        if spoil:
            children = children.withColumn("child_text", F.when(F.col("source") == spoil, F.raise_error(F.lit("a task fails"))).otherwise(F.col("child_text")))
        ledger = docs.select("source", F.sha2("text", 256).alias("fingerprint"), F.current_timestamp().alias("indexed_at"))
        return database.replace(ledger, parents, children, spark.createDataFrame([(g,) for g in gone], "source string"), url, batch, driver=driver)

    def held():
        found = database.read(spark, url, "parent_chunk", partitions=3, driver=driver)
        children = database.read(spark, url, "child_chunk", partitions=2, driver=driver)
        assert {r.parent_id for r in children.collect()} == {r.parent_id for r in found.collect()} and all(r.embedding == [0.5, 1.0] for r in children.collect())
        assert {r.source for r in database.read(spark, url, "source_document", driver=driver).collect()} == {r.source for r in found.collect()}
        return {r.source: r.parent_text for r in found.collect()}

    assert put({"/a": "one", "/b": "two", "/c": "three"}, [], "batch 1")
    assert held() == {"/a": "[x] one", "/b": "[x] two", "/c": "[x] three"}
    with pytest.raises(Exception, match="a task fails"):
        put({"/a": "changed", "/b": "changed"}, ["/c"], "batch 2", spoil="/b")
    assert held() == {"/a": "[x] one", "/b": "[x] two", "/c": "[x] three"}  # nothing of it is there
    assert put({"/a": "changed", "/d": "four"}, ["/c", "/none"], "batch 2")
    want = {"/a": "[x] changed", "/b": "[x] two", "/d": "[x] four"}
    assert held() == want
    assert not put({"/a": "again"}, ["/b"], "batch 2") and held() == want  # a repeated batch
    with database.Connection(spark, url, {"driver": driver}) as db:
        assert not any(db.has(f"stage_{hashlib.sha256(b.encode()).hexdigest()[:12]}_gone") for b in ("batch 1", "batch 2"))


def test_stream(spark, tmp_path):
    spark.createDataFrame([("/d/a", "alpha beta", "a")], "source string, text string, label string").write.parquet(f"{tmp_path}/in")
    store = Store(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        stream = spark.readStream.schema("source string, text string, label string").parquet(f"{tmp_path}/in")
        incremental.start(stream, store, f"file://{tmp_path}/cp").awaitTermination(120)
        assert store.read("parents").count() == 1
        spark.createDataFrame([("/d/a", "alpha gamma", "a")], "source string, text string, label string").write.mode("append").parquet(f"{tmp_path}/in")


def test_pairing_counts_and_reports(spark, sf):
    golden = spark.createDataFrame([(1, True, True), (2, True, False), (3, False, True), (4, True, True)], "qid int, answerable boolean, reviewed boolean").withColumn("anchors", F.array(F.struct(F.lit("").alias("source"), F.lit("").alias("heading_contains"), F.lit("x").alias("text_contains"))))
    rows = [(1, True, None, 0.5, 1), (2, True, None, 0.1, 9), (3, False, None, 0.2, 9), (4, True, "timeout", 0.3, 9)]
    kind = "qid int, answerable boolean, error string, used_ratio double, dropped int"
    paired = evaluate.pair(golden, spark.createDataFrame(rows, kind))
    total = evaluate.counts(paired)
    assert total.first().asDict() == {"n_items": 4, "n_answerable": 3, "n_unanswerable": 1, "n_expected": 1, "avg_used_ratio": 0.5, "avg_dropped": 1.0}
    assert evaluate.warnings(paired).first().warnings == ["unreviewed_items", "few_answerable", "few_unanswerable", "failed_items"]
    for wrong in (rows[:3], [*rows, rows[0]], [*rows[:3], (4, False, None, 0.0, 0)], [*rows[:3], (5, True, None, 0.0, 0)]):
        with pytest.raises(ValueError):
            evaluate.pair(golden, spark.createDataFrame(wrong, kind))
    judged = spark.createDataFrame([(1, 2, "p", [0], "the snippet", 0.7), (4, 1, "p", [0], "s", 0.9)], "qid int, rank int, parent_id string, matched array<int>, snippet string, score double")
    items = evaluate.item_metrics(judged, paired)
    measured = {r.k: r for r in evaluate.metrics(items).collect()}
    assert measured[1].n == 1 and measured[1].mrr == 0 and measured[3].mrr == 0.5
    nothing = evaluate.metrics(evaluate.item_metrics(judged, paired.filter("not answerable"))).collect()
    assert [(r.n, r.recall) for r in nothing] == [(0, 0.0)] * 4
    text = report.evaluation(evaluate.metrics(items), total, evaluate.failures(items, judged), evaluate.warnings(paired), {"vectors": "hash"})
    assert "| - | 3 | 1.000 | 1.000 | 0.500 |" in text and "failed_items" in text and "first match at rank 2" in text and "the snippet" in text
    assert json.loads(report.evaluation(evaluate.metrics(items), total, evaluate.failures(items, judged), evaluate.warnings(paired), form="json"))["counts"]["n_items"] == 4
    missing = spark.createDataFrame([(1, 0, ["p1"]), (2, 0, [])], "qid int, anchor int, near array<string>")
    assert "anchors: 4, of which 2" in report.anchors(golden, missing) and "half of it stands in p1" in report.anchors(golden, missing)
    assert "not indexed, " in report.index_summary(index_summary_of(spark))
    answers = answer.answer(queries._packed(spark, sf), answer.echo(F.col("blocks")))
    assert "coverage" in report.answers(answers, 3)


def index_summary_of(spark):
    return spark.createDataFrame([(5, 1, 2, 1, 2, 1, 7, 9, 0, {"not_implemented": 2})], "files int, skipped int, indexed int, empty int, unsupported int, degraded int, parents int, children int, deleted int, unsupported_reasons map<string, int>")


def test_trace_and_providers(spark):
    watched = trace.Trace()
    rows = watched.watch(spark.range(10), "all", most=F.max("id"))
    rows = watched.watch(rows.filter("id > 6"), "left")
    assert rows.count() == 3 and watched.report("all") == {"rows": 10, "most": 9} and watched.report("left") == {"rows": 3}
    with pytest.raises(ValueError):
        watched.watch(rows, "all")

    def words(prompt):
        if "bad" in prompt:
            raise OSError("gone")
        yield from prompt.split(" ")

    asked = spark.createDataFrame([("a  b",), ("bad",)], "p string")
    assert [r.t for r in asked.select(answer.streamed(words, backoff=0)("p").alias("t")).collect()] == [["a", "b"], None]
    texts = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, "ccc")], "id int, t string")
    cache = spark.createDataFrame([("bb", [2.0])], "t string, embedding array<float>").select(embed.text_key(F.col("t")).alias("key"), "embedding")
    provider = embed.lazily(lambda: lambda ts: [[float(len(t))] for t in ts])
    got, fresh = embed.cached(texts, cache, "t", provider, 1)
    assert {r.id: r.embedding for r in got.collect()} == {1: [1.0], 2: [2.0], 3: [1.0], 4: [3.0]} and fresh.count() == 2


def test_anchors_by_text_heading_and_file(spark):
    a = lambda s="", h="", t="": (s, h, t)
    golden = spark.createDataFrame([(1, [a(t="needle"), a(t="needle", h="Other"), a(h="Head"), a(s="x/f.md"), a(s="g.md", t="need"), a(s="none.md"), a(t="haystack!")])], "qid int, anchors array<struct<source: string, heading_contains: string, text_contains: string>>")
    parents = spark.createDataFrame([("p1", "a needle here", "The Head", "/d/f.md"), ("p2", "hays", None, "/d/h.md")], "parent_id string, parent_text string, heading string, source string")
    assert [(r.anchor, r.near) for r in evaluate.check_anchors(golden, parents).orderBy("anchor").collect()] == [(1, ["p1"]), (4, ["p1"]), (5, []), (6, [])]
    assert evaluate.check_anchors(golden.withColumn("anchors", F.slice("anchors", 7, 1)), parents.withColumn("parent_text", F.lit("has hays in it"))).first().near == []


def test_containing_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    texts = [None, "", *("".join(rng.choice("abé ") for _ in range(rng.randrange(60))) for _ in range(80))]
    needles = [None, "", *sorted({"".join(rng.choice("abé ") for _ in range(rng.randrange(1, 5))) for _ in range(40)})]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    n = spark.createDataFrame([(x,) for x in needles * 2], "n string")
    want = sorted((i, x) for i, text in enumerate(texts) for x in needles if x and x in (text or ""))
    for size in (contain.NEEDLE_BYTES, 30):
        monkeypatch.setattr(contain, "NEEDLE_BYTES", size)
        assert sorted((r.id, r.n) for r in contain.containing(t, "t", n, "n").collect()) == want
    assert contain.containing(t, "t", n.limit(0), "n").count() == 0


def test_reasons(spark):
    rows = [(None, "never_indexed"), ("abc", "legacy_format"), ("h.s", "unchanged"), ("x.s", "content"), ("h.x", "signature"), ("x.x", "content_and_signature")]
    got = spark.createDataFrame(rows, "stored string, want string").select("want", index.fingerprint_reason(F.col("stored"), F.lit("h"), F.lit("s")).alias("r")).collect()
    assert all(r.want == r.r for r in got)


def test_plans_prune_and_limit(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    c = retrieve.corpus(docs)
    plan = c.children._jdf.queryExecution().toString()
    assert "Exchange" not in plan.split("== Physical Plan ==")[1] and "n_chars" not in plan.split("ReadSchema")[1]
    asked = retrieve.questions(spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert "WindowGroupLimit" in retrieve.keyword_hits(c, asked, config.Retrieval())._jdf.queryExecution().toString()
    assert chunk.FENCE == "```"
