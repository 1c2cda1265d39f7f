import hashlib
import zlib

import numpy as np
import pytest
from helpers import docs, given
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oracle import compare
from tessera.llm import language_id, prefix_trie, whitening
from tessera.llm.queries import oracle_sql, op11_embedding_whitening, op12_prefix_trie, op13_language_id

# -- whitening -----------------------------------------------------------------------------------------------------


def check_whitened(rows, vectors):
    """Rows of ``whitened`` against plain numpy over (id, vector)."""
    x = np.array([[int(np.floor(1024 * float(c))) + 100000 for c in v] for _, v in vectors], object)
    n, s = len(x), x.sum(0)
    apart = np.array((x - np.array([float(v) / n for v in s])).tolist(), float)
    cov = apart.T @ apart / n
    values, directions = np.linalg.eigh(cov)
    values, directions = values[::-1], directions[:, ::-1]
    k = min(8, x.shape[1])
    assert len(rows) == n * k
    by_id = {}
    for r in rows:
        by_id.setdefault((r.vec_id, r.component), []).append(r)
    for j in range(k):
        plain = apart @ directions[:, j] / np.sqrt(values[j])
        mine = [by_id[i, j + 1] for i, _ in vectors]
        sign = np.sign(sum(p * m[0].whitened for p, m in zip(plain, mine)))
        assert np.allclose([m[0].whitened for m in mine], sign * plain, atol=1e-6)
        assert all(abs(m[0].explained - values[j] / np.trace(cov)) <= 1e-4 * m[0].explained for m in mine)
    exact = {i: int(((n * row - s) ** 2).sum()) for (i, _), row in zip(vectors, x)}
    assert all(r.deviation == exact[r.vec_id] and r.n == n for r in rows)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error <= 1e-4


def test_whitening_matches_numpy(spark, sf):
    rows = op11_embedding_whitening(spark, sf).collect()
    check_whitened(rows, [(r["vec_id"], r["embedding"]) for r in given(sf, "embeddings")])


VEC = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("_v", T.StringType()), T.StructField("_row", T.StringType()), T.StructField("component", T.LongType())])


def test_whitening_defined_cases(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(np.float32(v)) for v in rng.normal(size=3) * [3, 1, 0.2]]) for i in range(40)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0])]
    frame = lambda rows, parts=3: spark.createDataFrame([(i, v, "a", "b", 7) for i, v in rows], VEC).repartition(parts)
    check_whitened(whitening.whitened(frame(good + bad)).collect(), good)
    check_whitened(whitening.whitened(frame(good + good[:7])).collect(), [*good, *good[:7]])
    short = [(50, [0.5]), (51, []), (None, [1.0, 2.0])]
    filled = [(i, [*v, *[0.0] * (3 - len(v))]) for i, v in short]
    check_whitened(whitening.whitened(frame(good + short, 40)).collect(), good + filled)
    assert whitening.whitened(frame([])).collect() == [] and whitening.whitened(frame(bad)).collect() == []
    assert whitening.whitened(spark.createDataFrame([], VEC).limit(0)).collect() == []
    one = whitening.whitened(frame([(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.whitened, r.explained, r.deviation) for r in sorted(one, key=lambda r: r.component)] == [(1, None, None, 0), (2, None, None, 0)]
    flat = whitening.whitened(frame([(i, [float(i), 1.0]) for i in range(6)])).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-9 for r in flat)
    with pytest.raises(Exception, match="too large"):
        whitening.whitened(frame([(1, [3e20])])).collect()


def test_merging_is_exact_and_centred():
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 2000, size=(999, 5)) + 10**8  # squares of these would lose the variance in doubles
    parts = np.split(rows, [1, 7, 7, 500, 998])
    found = whitening.Moments.of(rows[:0])
    for part in parts:
        found = found.merged(whitening.Moments.of(part))
    apart = rows - rows.sum(0) / len(rows)
    assert found.n == 999 and (found.sums == rows.sum(0)).all() and np.allclose(found.scatter, apart.T @ apart, rtol=0, atol=1e-10 * found.scatter.max())
    big = np.array([[1 << 33], [-(1 << 33)]])
    assert whitening.deviation(np.array([[5], [7]]), 2, np.array([12])).tolist() == [4, 4]
    with pytest.raises(OverflowError):
        whitening.deviation(big, 2, big.sum(0))


# -- conversations ---------------------------------------------------------------------------------------------------


def slow_trie(rows):
    """rows: (conv_id, turn, role, text) -> a set of node rows, by plain recursion."""
    told = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            told.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    told = {c: [t[3:] for t in sorted(v)] for c, v in told.items()}
    paths = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(told.get(c - int(np.fmod(c, 100)), [])[:h] + own[h:])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    kids = {p: [] for p in members}
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(sums[k][0] for k in kids[p]) if kids[p] else 1
        sums[p] = leaves, sum(sums[k][1] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(paths[c]) == len(p)))
        out.append((min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), len(kids[p]), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


CONV = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("base", T.StringType()), T.StructField("x", T.StringType())])


def got_trie(spark, rows, **options):
    got = prefix_trie.trie(spark.createDataFrame([(*r, "b", "c") for r in rows], CONV).repartition(4), **options).collect()
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got), key=repr)


def invented(seed, convs=260, longest=9):
    """Conversations that share first turns within and across families, with nulls, ties, repeats and absent bases."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in [*range(-150, convs), 900, 901, 1000, 5050]:
        if rng.random() < 0.2 or c == 200:
            continue
        style = int(rng.integers(3))
        for t in range(int(rng.integers(1, longest))):
            text = f"t{style} {t}" if rng.random() < 0.8 else ["", None, "é" * 7, f"{c}"][int(rng.integers(4))]
            rows.append((c, None if rng.random() < 0.05 else t if rng.random() < 0.9 else 3, ["user", "assistant", None, ""][t % 4], text))
    rows += [r for r in rows if rng.random() < 0.03] + [(None, 1, "user", "nobody"), (None, None, None, None)]
    return rows


def test_trie_matches_brute_force(spark, sf):
    rows = invented(1)
    assert got_trie(spark, rows) == slow_trie(rows)
    whole = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in given(sf, "conversations")]
    assert got_trie(spark, whole) == slow_trie(whole)


def test_trie_of_long_conversations_in_pieces(spark):
    rows = invented(2, 120)
    rows += [(c, t, "user", f"line {t % 7} {'own' if t == 40 and c == 77 else ''}") for c in (0, 3, 77, 300, 999) for t in range(90)]  # a long base, copies, an absent base
    rows += [(7, 5, "user", "the same")] * 60
    want = slow_trie(rows)
    for most in (0, 2, 50, 10_000):
        assert got_trie(spark, rows, long=most) == want, most


def test_trie_defined_cases(spark):
    assert got_trie(spark, []) == [] == got_trie(spark, [(None, 1, "a", "b")])
    # conversation 107's base is absent and all its turns are within the first h: the root alone
    absent = next(c for c in range(100, 200) if zlib.crc32(str(c).encode()) % 6 == 5)
    assert got_trie(spark, [(absent, 0, "user", "gone")]) == [(absent, 0, None, 1, 0, 1, 0, hashlib.sha256(str(absent).encode()).hexdigest())]
    chain = [(c, t, "u", "x" * 1000) for c in range(30) for t in range(c + 1)]  # each extends the one before
    assert got_trie(spark, chain) == slow_trie(chain)


def test_trie_matches_sql(spark):
    compare(spark, "/root/testdata/sf0.01", op12_prefix_trie, oracle_sql()["op12_prefix_trie"])


# -- languages ----------------------------------------------------------------------------------------------------


def slow_counts(text):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    letters = " " + " ".join(letters.split()) + " "
    found = {}
    for n in (1, 2, 3, 4):
        for i in range(len(letters) - n + 1):
            found[letters[i : i + n]] = found.get(letters[i : i + n], 0) + 1
    return found


def test_places_are_those_of_character_ngrams(monkeypatch):
    text = "Ein Text, 2 Wörter... und \U0001d518 mehr—\n Worte; ein Text"
    whole = language_id.counts(text)
    assert whole.sum() == sum(slow_counts(text).values())
    long = "wörter und sätze " * 500
    want = language_id.counts(long)
    assert want.sum() == sum(slow_counts(long).values())
    monkeypatch.setattr(language_id, "PART", 97)
    assert (language_id.counts(long) == want).all() and (language_id.counts(text) == whole).all()
    assert language_id.counts("12 !? \n") is None and language_id.counts(None) is None and language_id.counts("") is None


def test_a_step_of_the_leader_matches_a_plain_computation():
    rng = np.random.default_rng(7)
    rows = [(np.sort(rng.choice(50, 6, replace=False)), rng.random(6), int(rng.integers(3))) for _ in range(40)]
    ftrl = language_id.Ftrl(3, places=50, epochs=2, l1=0.05)
    got = ftrl.fit(rows)
    z, n = np.zeros((51, 3)), np.zeros((51, 3))

    def weight(i, k):
        if abs(z[i, k]) <= ftrl.l1:
            return 0.0
        return -(z[i, k] - np.sign(z[i, k]) * ftrl.l1) / ((ftrl.beta + n[i, k] ** 0.5) / ftrl.alpha + ftrl.l2)

    for place, value, y in rows * 2:
        x = [*zip(place.tolist(), value.tolist()), (50, 1.0)]
        old = {(i, k): weight(i, k) for i, _ in x for k in range(3)}
        e = np.exp([sum(old[i, k] * v for i, v in x) for k in range(3)])
        p = e / e.sum()
        for i, v in x:
            for k in range(3):
                g = (p[k] - (k == y)) * v
                sigma = ((n[i, k] + g * g) ** 0.5 - n[i, k] ** 0.5) / ftrl.alpha
                z[i, k] += g - sigma * old[i, k]
                n[i, k] += g * g
    assert np.allclose(got, [[weight(i, k) for k in range(3)] for i in range(51)])
    assert (got == 0).any()


def test_temperature_minimises_the_loss():
    rng = np.random.default_rng(2)
    logits, y = rng.normal(size=(300, 4)) * 8, rng.integers(4, size=300)
    y[:200] = logits[:200].argmax(1)
    loss = lambda t: -np.log(language_id._softmax(logits / t)[np.arange(300), y]).mean()
    t = language_id.temperature(logits, y)
    assert all(loss(t) <= loss(t * f) + 1e-12 for f in (0.5, 0.9, 0.99, 1.01, 1.1, 2))
    assert language_id.temperature(np.zeros((0, 4)), np.zeros(0, int)) == 1.0


def test_frequencies_cover_all_rows_and_scores_match_a_plain_computation(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    may = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    rows = language_id._learnable(frame, may, "doc_id", "text", "lang")
    n, df = language_id.document_frequencies(rows)
    plain = [r for r in given(sf, "documents") if r["text"] and r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    want = sum((language_id.counts(r["text"]) > 0).astype(int) for r in plain if language_id.counts(r["text"]) is not None)
    assert n == sum(language_id.counts(r["text"]) is not None for r in plain) and (df == want).all()
    model = language_id.train(frame, may)
    got = {r["_row"].doc_id: r for r in language_id.predict(frame, model).collect()}
    for r in given(sf, "documents")[:40]:
        c = language_id.counts(r["text"])
        if c is None:
            continue
        v = np.log1p(c) * model.idf
        p = language_id._softmax((v / np.linalg.norm(v) @ model.weights[:-1] + model.weights[-1]) / model.temperature)
        assert got[r["doc_id"]].lang_pred == model.languages[int(p.argmax())] and abs(got[r["doc_id"]].score - p.max()) < 1e-6


def test_languages_are_told_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = op13_language_id(spark, sf).collect()
    truth = {r["doc_id"]: r["lang"] for r in given(sf, "documents")}
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und" and truth[r.doc_id]]
    right = [r.lang_pred == truth[r.doc_id] for r in held]
    assert len(held) > 100 and sum(right) >= 0.97 * len(right)
    assert abs(np.mean([r.score for r in held]) - np.mean(right)) < 0.05


def test_language_defined_cases(spark):
    texts = ["der hund und die katze", "the dog and the cat", None, "", "123 ...", "le chien et le chat " * 20000, "der hund und die katze"]
    frame = spark.createDataFrame([(i if i != 1 else None, t, [None, "en", "xx", "de", "en", "fr", "de"][i], "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, lang string, _l string, lang_pred string")
    model = language_id.train(frame)
    assert model.languages == ("de", "en", "fr")
    got = language_id.predict(frame, model).collect()
    assert len(got) == 7 and {r["_row"].text for r in got if r.lang_pred == "und"} == {None, "", "123 ..."} and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert all(r["_row"].lang_pred == "y" for r in got)
    none = language_id.train(frame.filter("lang is null"))
    assert {r.lang_pred for r in language_id.predict(frame, none).collect()} == {"und"}
    one = language_id.predict(frame, language_id.train(frame.filter("lang = 'fr'"))).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("und", 0.0), ("fr", 1.0)}
    assert language_id.predict(docs(spark, []), language_id.train(docs(spark, []))).collect() == []
