import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import docs, given, prose
from oracle import compare
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing, queries, substring, topk
from tessera.llm.fm_index import FmIndex, suffix_array
from tessera.llm.word_bpe import WordBpe


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, sf, name):
    assert compare(spark, sf, queries.queries()[name], queries.oracle_sql()[name]) > 0


# -- top-k -------------------------------------------------------------------------------------------


def slow_top(rows, k):
    out = []
    for q, v in rows:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_topk_prunes_and_stays_exact(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        center = (i % 7) * np.ones(8) * (1 if i % 2 else -1)
        rows.append((i, [float(x) for x in np.round(center + rng.normal(0, 0.3, 8), 3)]))
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") % 100 == 0, block=16, shard=200)
    quantised = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == slow_top(quantised, 10)
    ids, m = np.array([i for i, _ in quantised]), np.array([v for _, v in quantised])
    order = np.argsort(m.sum(1))
    blocks = [(ids[p], m[p], m[p].max(0), m[p].min(0)) for p in np.array_split(order, 40)]
    *_, scored = topk.search_blocks(ids[:1], m[:1], blocks, 10)
    assert scored < len(blocks) / 2


def test_topk_awkward_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, []), (6, [3.0]), (None, [9.0, 9.0]), (100, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("id", F.lit(1))
    got = Counter((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect())
    one = {(0, 1, 6, 3 * 1024 * 1024), (0, 2, 100, 1024 * 512 * 3), (0, 3, 5, 0)}
    assert all(got[x] == 2 for x in one)
    assert got[(100, 1, 0, 1024 * 512 * 3)] == 1 and got[(100, 3, 6, 3 * 1024 * 512)] == 1
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


# -- substring dedup -----------------------------------------------------------------------------------


def slow_substring(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def substring_cases():
    rng = random.Random(9)
    passage = prose(100, 60)
    texts = [f"{prose(i, rng.randrange(5, 60))} {passage} {prose(1000 + i, rng.randrange(5, 60))}" for i in range(40)]
    near = prose(7, 300).split()
    for i in range(15):
        w = list(near)
        w[rng.randrange(300)] = f"edit{i}"
        texts.append(" ".join(w))
    texts += [None, "", "short text", prose(3, 34), prose(4, 35), prose(4, 35), "ha " * 200, prose(8, 20_000), prose(9, 100) + "\n" + prose(9, 100)]
    return texts + texts[:3]


@pytest.mark.parametrize("shard_words", [400_000, 500])
def test_substring_matches_brute_force(spark, shard_words):
    texts = substring_cases()
    ids = [*range(len(texts) - 3), 0, 1, None]
    table = docs(spark, texts, ids=ids).withColumn("kept", F.lit("clash")).withColumn("_id", F.lit(5))
    got = substring.deduplicate(table, shard_words=shard_words)
    have = Counter((r["_row"]["doc_id"], r["_row"]["text"], r["n_words"], r["n_removed"], r["kept"]) for r in got.collect())
    assert have == Counter((i, t, *x) for i, t, x in zip(ids, texts, slow_substring(texts, 35)))


def test_a_crowd_streams_through_its_shards():
    """Segments of one minimiser, dealt to 4 shards: whole counts, and never more rows at a time than a shard's share or part."""
    import xxhash

    window, limit = 35, 2000
    common = prose(3, 40).split()
    texts = sorted({" ".join([f"a{n % 90}", *common, f"b{n % 70}"]).encode() for n in range(400)})
    rows = []
    for salt in range(4):
        mine = [(1, xxhash.xxh3_64_intdigest(t) >> 1, 1, 4, salt, t, (xxhash.xxh3_64_intdigest(t) >> 1) % 4 == salt) for t in texts]
        rows += sorted(mine, key=lambda r: (not r[6], r[1]))
    names = ["least", "content", "weight", "g", "salt", "words", "indexed"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
    total, most = {}, 0
    for out in substring._searched(window, limit)(iter([batch])):
        most = max(most, out.num_rows)
        for r in out.to_pylist():
            total[r["content"]] = total.get(r["content"], 0) + np.frombuffer(r["counts"], np.uint8).astype(int)
    assert most <= max(limit // 42 + 1, max(sum(r[6] for r in rows if r[4] == salt) for salt in range(4)))
    windows = Counter(tuple(t.split()[i : i + window]) for t in texts for i in range(len(t.split()) - window + 1))
    for t in texts:
        words = t.split()
        want = np.array([windows[tuple(words[i : i + window])] for i in range(len(words) - window + 1)])
        assert (np.minimum(total[xxhash.xxh3_64_intdigest(t) >> 1], 2) == np.minimum(want, 2)).all()


def test_equal_rows_take_linear_time(spark):
    table = docs(spark, [prose(5, 400)] * 3000, ids=[7] * 3000)
    began = time.perf_counter()
    rows = substring.deduplicate(table).select("n_words", "n_removed").distinct().collect()
    assert [(r.n_words, r.n_removed) for r in rows] == [(400, 400)] and time.perf_counter() - began < 60


def test_substring_of_small_windows_and_no_rows(spark):
    texts = ["a b a b a", "b a", "c", "a a a a"]
    got = {r["_row"]["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.deduplicate(docs(spark, texts), window=2).collect()}
    assert [got[i] for i in range(4)] == slow_substring(texts, 2)
    assert substring.deduplicate(docs(spark, [])).count() == 0
    kept = substring.remove(docs(spark, [prose(1, 80), prose(1, 80), "x  y"]))
    rows = {r.doc_id: r for r in kept.collect()}
    assert rows[0].text == "" and rows[0].n_chars == 0 and rows[2].text == "x  y" and rows[2].n_chars == 4


def test_fm_index_counts():
    rng = np.random.default_rng(0)
    sequences = [rng.integers(0, 5, rng.integers(1, 60)) for _ in range(30)]
    weights = rng.integers(1, 4, 30)
    index = FmIndex(sequences, weights, 5)
    stream = np.concatenate([*sequences, [-1, 3]])
    ends = np.arange(3, len(stream))
    want = []
    for e in ends:
        pattern = list(stream[e - 3 : e + 1])
        want.append(sum(w for s, w in zip(sequences, weights) for i in range(len(s) - 3) if list(s[i : i + 4]) == pattern))
    got = index.matches(stream, ends, 4, least=1)
    assert got.tolist() == want
    inside = np.concatenate([np.arange(e - len(s) + 3, e) for s, e in zip(sequences, np.cumsum([len(s) for s in sequences]))])
    again = index.matches(np.concatenate(sequences), inside, 4, least=1, indexed=True)
    assert again.tolist() == [want[e - 3] for e in inside]
    text = np.append(rng.integers(1, 3, 200), 0)
    assert suffix_array(text).tolist() == sorted(range(201), key=lambda i: text[i:].tolist())


# -- packing -------------------------------------------------------------------------------------------


def check_packing(rows, ids_of, capacity=4096, copies=1):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(ids_of)
    for d, ids in ids_of.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start)[::copies]:
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == len(ids)
    used = 0
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        used += at
    return used, len(by_sequence)


def test_packing_matches_tokenizer(spark, sf):
    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    ids = {r["doc_id"]: whole.encode(r["text"], add_special_tokens=False).ids + [2] for r in given(sf, "documents")}
    used, sequences = check_packing(queries.op3_packing(spark, sf).collect(), ids)
    assert used >= 0.9 * (sequences - 1) * 4096


def test_packing_awkward_rows(spark):
    texts = [None, "", "a", "b b", prose(1, 50_000), prose(2, 300)]
    table = docs(spark, texts).withColumn("length", F.lit(1)).withColumn("sequence_id", F.lit("x"))
    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    ids = {i: whole.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    check_packing(packing.pack(table).collect(), ids)
    twice = packing.pack(table.union(table), with_ids=True).collect()
    check_packing(twice, ids, copies=2)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in twice)
    assert packing.pack(docs(spark, [])).count() == 0
    assert all(sum(packing.cut(n)) == n and all(p in {n for n, _ in packing.classes()} for p in packing.cut(n)) for n in range(1, 9000))
    assert packing.most_left_over() < 40_000


def test_word_bpe_equals_library():
    bpe, whole = WordBpe(public_tokenizers.path(packing.TOKENIZER)), Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    odd = ["Été naïve ÀÇ×÷ß don't I'LL 'sup x's 12a3 <|endoftext|> a<|startoftext|>b", "ΣΑΣ σας İI ǅ", "é a b c d \x1c x\x1fy ​", "日本語 テスト 한국어 😀👍🏽 ½ ² ª º µ", "á̧ ́x ﬁ K Å", "", " \n\t ", "a.b,c!!!***$$$ ''' 's's", "ÿ\u0085z"]
    random.seed(2)
    odd += ["".join(chr(random.choice([random.randrange(32, 127), random.randrange(160, 592), 32, 10, 39])) for _ in range(200)) for _ in range(300)]
    for t in odd:
        assert bpe.ids(t.encode()).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_word_bpe_cuts_like_the_library(monkeypatch):
    from tessera.llm import common, word_bpe

    bpe, whole = WordBpe(public_tokenizers.path(packing.TOKENIZER)), Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    # one entry a piece: words that differ only in their signs are not remembered one by one
    common.forget()
    list(bpe.encode_all([" ".join(f"word{'.' * i}" for i in range(1, 150)).encode()] * 9))
    list(bpe.encode_all([" ".join(f"other{'.' * i}" for i in range(1, 150)).encode()] * 9))
    assert len(common.memo(bpe.owner, 10**9)) == 151
    monkeypatch.setattr(word_bpe, "MEMO", 200)
    monkeypatch.setattr(word_bpe, "TOGETHER", 500)
    random.seed(5)
    parts = [*"abzABZ019'''''-.<|$ \n\t", "'s", "'LL", "'re", "'VE", "É", "é", "ß", "×", "÷", "\x1c", "日", "́", "İ", "Σ", "\x7f", "<|endoftext|>", "’", "\u0085", "¿", " "]
    texts = ["".join(random.choice(parts) for _ in range(random.randrange(40))) for _ in range(3000)]
    got = bpe.encode_all([None, *[t.encode() for t in texts]])
    assert next(got) == b""
    for t, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_hash_of_kept_text(spark, sf):
    rows = queries.op2_substring_dedup(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in given(sf, "documents")}
    for r in rows:
        if not r.n_removed:
            assert r.kept_sha256 == hashlib.sha256(b" ".join(texts[r.doc_id].encode().split())).hexdigest()
