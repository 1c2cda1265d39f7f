import functools
import gzip
import io
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from helpers import docs, given, prose
from pyspark.sql import functions as F

from tessera.llm import license_scan, piece_sampling, queries, warc, warc_pages

# -- WARC ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip_and_pushdown(spark, tmp_path, compression):
    big, page = "x" * 2000, spark.createDataFrame
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nWARC-Type: evil", big), (3, None, None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (7, "é", "é" * 600), (7, "é", "é" * 600), (None, "n", big), (-9, "u", big)]
    pages = page(rows, "page_id long, url string, html string").withColumn("payload", F.lit(3)).withColumn("type", F.lit("t"))
    path = f"file://{tmp_path}/archive"
    warc_pages.write_archive(pages, path, compression)
    every = warc_pages.read_archive(spark, path, verify="true")
    got = Counter((r.record_id, r.type, r.refers_to, None if r.payload is None else bytes(r.payload).decode()) for r in every.collect())
    last = "<urn:page:2>"
    want = [("<urn:page:1>", "revisit", last, None), (last, "response", None, big), ("<urn:page:3>", "response", None, ""), ("<urn:page:4>", "response", None, ""), ("<urn:page:5>", "response", None, "small"), ("<urn:page:6>", "response", None, "small"), ("<urn:page:7>", "response", None, "é" * 600), ("<urn:page:7>", "response", None, "é" * 600), ("<urn:page:none>", "revisit", last, None), ("<urn:page:-9>", "revisit", last, None)]
    assert got == Counter(want)
    only = warc_pages.read_archive(spark, path, payload="false").filter((F.col("type") == "revisit") & F.col("record_id").isin("<urn:page:1>", "<urn:page:5>"))
    assert [(r.record_id, r.payload_length, r.payload) for r in only.collect()] == [("<urn:page:1>", 2000, None)]
    assert {r.target_uri for r in every.filter("record_id = '<urn:page:2>'").collect()} == {"http://a/2%0D%0AWARC-Type:%20evil"}


def test_filters_are_taken_by_the_reader():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = warc.WarcReader({"path": "/nowhere"})
    left = list(reader.pushFilters([EqualTo(("type",), "response"), In(("record_id",), ("a", "b")), GreaterThan(("payload_length",), 3)]))
    assert [type(f) for f in left] == [GreaterThan]
    assert reader._keep({"warc-type": "response", "warc-record-id": "a"}) and not reader._keep({"warc-type": "revisit", "warc-record-id": "a"})


def test_unwanted_records_are_passed_over():
    rows = [{"record_id": f"<r:{i}>", "type": "response", "payload": np.random.default_rng(i).bytes(300_000)} for i in range(20)]
    data = b"".join(warc.member(warc.record(r), 1) for r in rows)
    assert gzip.decompress(data) == b"".join(warc.record(r) for r in rows)  # ordinary gzip, whatever the extra field

    class Counting(io.BytesIO):
        got = 0

        def read(self, n=-1):
            out = super().read(n)
            self.got += len(out)
            return out

    f = Counting(data)
    found = list(warc.records(f, True, lambda h: h["warc-record-id"] == "<r:13>", verify=True))
    assert [bytes(r["payload"]) for r in found] == [rows[13]["payload"]] and f.got < len(data) / 2
    plain = b"".join(gzip.compress(warc.record(r)) for r in rows)  # members without skip lengths
    assert len(list(warc.records(io.BytesIO(plain), True))) == 20
    bad = warc.record(rows[0]).replace(rows[0]["payload"][:50], b"!" * 50)
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(bad), False, verify=True))


def test_empty_archive(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    warc_pages.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc_pages.read_archive(spark, path).count() == 0


# -- piece sampling -------------------------------------------------------------------------------------------


def test_sampling_is_reproducible_and_lossless(spark, sf):
    rows = queries.op10_sentencepiece(spark, sf).collect()
    assert len(rows) == len(given(sf, "documents")) and all(r.round_trip for r in rows)
    texts = [None, "", " ", "  two  blanks ", "▁ own ▁▁mark▁", "日本語 \U0001f600 \x00\x07", "a" * 5000, " " * 1000 + "x", prose(1, 30_000), "new\nline\ttab", "é é"]
    table = docs(spark, texts).withColumn("pieces", F.lit(1))
    first = {r.doc_id: r.pieces for r in piece_sampling.sample(table).collect()}
    again = {r.doc_id: r.pieces for r in piece_sampling.sample(table.repartition(5).orderBy(F.desc("doc_id"))).collect()}
    assert first == again and first[0] is None and first[1] == []
    back = piece_sampling.sample(table).select("doc_id", piece_sampling.decode(F.col("pieces")).alias("t")).collect()
    assert {r.doc_id: r.t for r in back} == dict(enumerate(texts))
    assert piece_sampling.sample(docs(spark, [])).count() == 0
    keyless = docs(spark, ["some words here"] * 2, ids=[None, None])
    assert len({tuple(r.pieces) for r in piece_sampling.sample(keyless).collect()}) == 1


def _drawn(seed, n):
    """Number ``n`` of SplitMix64, in whole numbers."""
    wrap = (1 << 64) - 1
    z = (seed + (n + 1) * 0x9E3779B97F4A7C15) & wrap
    z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & wrap
    z = ((z ^ z >> 27) * 0x94D049BB133111EB) & wrap
    return ((z ^ z >> 31) >> 11) / (1 << 53)


def _one_by_one(text, seed, alpha):
    """Sampled ids of a text, word by word with plain lists and exact fractions for the sums."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_sampling.public_tokenizers.path(piece_sampling.MODEL))
    ids = {model.id_to_piece(i): i for i in range(len(model)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    best = max(model.get_score(i) for i in ids.values())
    weight = {i: Fraction(math.exp(-alpha * math.log(2 + best - model.get_score(i)))) for i in ids.values()}
    spelt = lambda ch: [model.piece_to_id(f"<0x{b:02X}>") for b in ch.encode()]
    out, begin = [], 0
    text = "▁" + text.replace("▁", "\0▁").replace(" ", "▁") if text else ""
    for own in re.split("(\0▁)", text):
        if own == "\0▁":
            out += spelt("▁")
            begin += 2
            continue
        for word in re.findall("▁+[^▁]*|[^▁]+", own):
            ways, into = [Fraction(1)], [[]]
            for end in range(1, len(word) + 1):
                found = [(a, [ids[word[a:end]]], weight[ids[word[a:end]]]) for a in range(max(0, end - 48), end) if word[a:end] in ids]
                if word[end - 1] not in ids:
                    found.append((end - 1, spelt(word[end - 1]), Fraction(1e-17)))
                into.append([(a, i, ways[a] * w) for a, i, w in found])
                ways.append(sum(x[2] for x in into[-1]))
            end, back = len(word), []
            while end:
                target, total = Fraction(_drawn(seed, begin + end)) * ways[end], Fraction(0)
                for a, i, w in into[end]:
                    total += w
                    if target < total:
                        break
                back.append(i)
                end = a
            out += [i for part in reversed(back) for i in part]
            begin += len(word)
    return out


def test_samples_equal_those_drawn_one_by_one(spark, sf):
    rows = {r.doc_id: (r.n_pieces, r.ids_crc32) for r in queries.op10_sentencepiece(spark, sf).collect()}
    table = spark.read.parquet(f"{sf}/documents.parquet")
    seeds = {r.doc_id: r.s for r in table.select("doc_id", piece_sampling.row_seed(F.col("doc_id")).alias("s")).collect()}
    wrap = (1 << 64) - 1
    compared = 0
    for r in given(sf, "documents"):
        if len(r["text"] or "") < 2500:
            ids = np.array(_one_by_one(r["text"] or "", seeds[r["doc_id"]] & wrap, piece_sampling.ALPHA), "<u4")
            assert rows[r["doc_id"]] == (len(ids), zlib.crc32(ids.tobytes())), r["doc_id"]
            compared += 1
    assert compared > 100
    p = piece_sampling.pieces(piece_sampling.public_tokenizers.path(piece_sampling.MODEL), 0.5)
    texts = ["▁ own ▁▁mark▁ ", "日本語の長い文" * 30 + "\U0001f600\x00\x07", "a1b2c3" * 40, " " * 200 + "x  y", "é" * 129, "word " + "Word" * 32, "x" * 128]
    seeds = np.array([wrap - i for i in range(len(texts))], np.uint64)
    ((ids, bounds),) = p.encode_all(texts, seeds)
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == _one_by_one(text, int(seeds[i]), 0.5) == p.encode(text, int(seeds[i])), text


def test_samples_follow_the_lattice():
    p = piece_sampling.Pieces(piece_sampling.public_tokenizers.path(piece_sampling.MODEL), 0.3)
    word = "▁the"
    weights = {}

    def walk(at, ids, log):
        if at == len(word):
            weights[tuple(ids)] = math.exp(log)
        for end in range(at + 1, len(word) + 1):
            i = p.id.get(word[at:end])
            if i is not None:
                walk(end, [*ids, i], log + p.log[i])

    walk(0, [], 0.0)
    total = sum(weights.values())
    n = 20_000
    seen = Counter(tuple(p.encode("the", seed)) for seed in range(n))
    assert set(seen) <= set(weights) and len(weights) > 3
    for ids, w in weights.items():
        want = w / total
        assert abs(seen[ids] / n - want) < 5 * math.sqrt(want * (1 - want) / n) + 1e-3


def test_pieces_cross_any_place_of_a_long_run_of_blanks():
    p = piece_sampling.Pieces(piece_sampling.public_tokenizers.path(piece_sampling.MODEL), 0.3)
    size = {i: len(piece) for piece, i in p.id.items()}
    ends = [{sum(size[i] for i in ids[:n]) for n in range(len(ids))} for ids in (p.encode(" " * 200 + "x", seed) for seed in range(40))]
    assert all(any(place not in e for e in ends) for place in (64, 128, 192))


# -- licences ------------------------------------------------------------------------------------------------------


def test_scan_finds_planted_notices(spark, sf):
    notices = {"mit": "Released under the MIT License.", "apache": "Licensed under the Apache License, Version 2.0.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc": "Licensed under CC BY-NC 4.0."}
    texts = [f"{prose(i, 50)}\n{t}\n{prose(i + 50, 20)}" for i, t in enumerate(notices.values())]
    texts += ["He lost his license in version 3 of the game.", None, "", "\n \n", prose(5, 30_000), "Copyright and permission are words.", "RELEASED UNDER THE MIT LICENSE"]
    table = docs(spark, texts).withColumn("family", F.lit("clash"))
    scanner = license_scan.train(table)
    got = {(r.doc_id, r.paragraph): (r.family, r.confirmed) for r in license_scan.scan(table, scanner).collect()}
    assert {k: v for k, v in got.items() if v[1]} == {(i, 1): (f, True) for i, f in enumerate(notices)} | {(10, 0): ("mit", True)}
    empty = docs(spark, [])
    assert license_scan.scan(empty, license_scan.train(empty)).count() == 0


def test_scan_finds_notices_inside_long_lines_and_wrapped(spark):
    import textwrap

    notices = {"mit": "Released under the MIT License.", "apache": "Licensed under the Apache License, Version 2.0.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc": "Licensed under CC BY-NC 4.0."}
    texts, want = [], {}
    for family, notice in notices.items():
        for n in (0, 20, 103, 1000):
            want[(len(texts), 1)] = family
            texts.append(f"{prose(n, 9)}\n{prose(n + 1, n)} {notice} {prose(n + 2, n)}")
    for family in ("mit", "gpl", "bsd"):
        for width in (40, 80):
            want[(len(texts), 2)] = family
            texts.append(f"{prose(3, 30)}\n{prose(4, 12)}\n" + textwrap.fill(license_scan.TEMPLATES[family][0], width) + f"\n{prose(6, 40)}")
    want |= {(len(texts), 0): "mit", (len(texts), 1): "apache"}
    texts.append(f"{notices['mit']}\n{prose(9, 300)} {notices['apache']} {prose(10, 300)}")
    table = docs(spark, texts)
    got = Counter((r.doc_id, r.paragraph, r.family) for r in license_scan.scan(table, license_scan.train(table)).collect() if r.confirmed)
    assert got == Counter((i, p, f) for (i, p), f in want.items())


def _slow_scan(text, scanner):
    """Hits of one text: every line and window with a cue is classified by plain sums, and the best that do not overlap are kept."""
    import regex
    from pyspark.ml.feature import HashingTF

    place = functools.cache(HashingTF(numFeatures=1 << license_scan.BITS).indexOf)
    weights, bias = scanner.model.coefficientMatrix.toArray(), scanner.model.interceptVector.toArray()
    lines = text.split("\n")
    by_line = [regex.findall(r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*", line.lower()) for line in lines]
    words, line_of = [w for ws in by_line for w in ws], [i for i, ws in enumerate(by_line) for _ in ws]
    units = [(False, line_of.index(i), ws, [i] * len(ws), lines[i]) for i, ws in enumerate(by_line) if ws]
    for size in license_scan.WINDOWS:
        for at in range(0, max(len(words), 1), size // 2):
            units.append((True, at, words[at : at + size], line_of[at : at + size], " ".join(words[at : at + size])))
    hits = []
    for window, begin, ws, of, said in units:
        grams = set(ws) | {f"{a} {b}" for a, b in zip(ws, ws[1:])}
        logits = bias + weights[:, sorted({place(g) for g in grams})].sum(1)
        p = np.exp(logits - logits.max())
        p /= p.sum()
        best = 1 + int(p[1:].argmax())
        if p[best] < scanner.threshold:
            continue
        family = scanner.families[best - 1]
        templates = license_scan._template_grams()[family]
        similarity = max(len(grams & set(t)) / len(t) for t in templates)
        own = {g for t in templates for g in t}
        at = [i for i in range(len(ws)) if " ".join(ws[i : i + 2]) in own]
        low, high = (min(at), min(max(at) + 1, len(ws) - 1)) if at else (0, len(ws) - 1)
        hits.append((similarity < license_scan.CONFIRMED, window, -similarity, -p[best], begin, of[low], family, begin + low, begin + high, said))
    kept = []
    for x in sorted(hits):
        if not any((x[7] <= y[8] and y[7] <= x[8]) or (x[5] == y[5] and x[6] == y[6]) for y in kept):
            kept.append(x)
    return sorted((x[5], x[6], round(-x[3], 5), round(-x[2], 5), not x[0]) for x in kept)


def test_scan_matches_brute_force(spark):
    import textwrap

    texts = [f"{prose(n, 20)}\n{t}\n{prose(n + 1, 30)} {t} {prose(n + 2, 40)}" for n, t in enumerate(t for ts in license_scan.TEMPLATES.values() for t in ts)]
    texts += [textwrap.fill(ts[0], 40) + "\n\n" + ts[-1] for ts in license_scan.TEMPLATES.values()] + license_scan.BACKGROUND + ["", "\n", prose(3, 300), "licence", "the copyright\n\nof the domain"]
    table = docs(spark, [*texts, None, texts[0]], ids=[*range(len(texts)), None, 0])
    scanner = license_scan.train(table)
    got = {}
    for r in license_scan.scan(table, scanner).collect():
        got.setdefault(r.doc_id, []).append((r.paragraph, r.family, round(r.probability, 5), round(r.similarity, 5), r.confirmed))
    assert sum(map(len, got.values())) > len(texts) - 30
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == sorted(_slow_scan(text, scanner) * (2 if i == 0 else 1)), text


def test_scan_on_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = Counter((r.doc_id, r.paragraph) for r in queries.op5_license_scan(spark, sf).collect() if r.confirmed)
    want = Counter((r["doc_id"], i) for r in given(sf, "documents") for i, line in enumerate((r["text"] or "").split("\n")) if re.search(r"(Released|[Ll]icensed) under", line))
    assert got == want


def test_no_python_in_the_scan(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    plan = license_scan.scan(table, license_scan.train(table))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)


def test_scan_judges_paragraphs_whatever_their_words(spark):
    texts = ["This work is available under a Creative Commons Attribution-NonCommercial 4.0 International deed.", "Terms: GNU General Public, either version 3, or (at your option) any later version.", "free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", prose(3, 100)]
    table = docs(spark, [f"{prose(i, 30)}\n{t}\n{prose(i + 9, 30)}" for i, t in enumerate(texts)])
    scanner = license_scan.train(table)
    got = {(r.doc_id, r.paragraph, r.family) for r in license_scan.scan(table, scanner).collect()}
    assert {(0, 1, "cc-by-nc"), (2, 1, "mit")} <= got and 3 not in {i for i, _, _ in got}, got
    assert license_scan.units_of(table).select("_id").distinct().count() == len(texts)


def test_model_and_threshold_come_from_every_paragraph(spark):
    texts = [prose(i, 12) for i in range(1000)]
    last = [r.doc_id for r in docs(spark, texts).orderBy(F.xxhash64("doc_id").desc()).limit(10).collect()]
    changed = [t + " software" if i in last else t for i, t in enumerate(texts)]
    a, b = (license_scan.train(docs(spark, ts)).model.coefficientMatrix.toArray() for ts in (texts, changed))
    assert abs(a - b).max() > 1e-5
    judged = spark.createDataFrame([(p,) for p in [0.1] * 95 + [0.7, 0.8, 0.8, 0.9, 0.95]], "_best double")
    passing = lambda least: judged.filter(F.col("_best") >= least).count()
    assert passing(license_scan._calibrated(judged)) == 1 and license_scan._calibrated(judged.filter("_best < 0.5")) == license_scan.LEAST


def test_scan_passes_over_spans_that_cannot_hold_a_notice(spark):
    notices = [t for ts in license_scan.TEMPLATES.values() for t in ts]
    given_texts = [r["text"] for r in given("/root/testdata/sf0.01", "documents")][: 2 * len(notices)]
    texts = [f"{text} {t}\n{prose(n, 33 + n)}" for n, (t, text) in enumerate(zip(notices, given_texts, strict=False))] + given_texts + ["a", "\n\n b", None, "", prose(7, 96), prose(8, 97), "\n".join(["word"] * 300)]
    table = docs(spark, texts)
    scanner = license_scan.train(table)
    laid = license_scan._laid_out(table, "doc_id", "text")
    spans = license_scan._spans(laid)
    key = lambda r: (r["_id"], r["_window"], r["_begin"], " ".join(r["_words"]))
    every = license_scan.units_of(table).cache()
    # each line and window is in one span, and those of the possible spans hold all hits
    assert Counter(map(key, license_scan._units(spans).collect())) == Counter(map(key, every.collect()))
    judged = Counter(map(key, license_scan._units(scanner.possible(spans)).collect()))
    hits = [key(r) for r in scanner.classified(every).filter("family <> 'unknown'").collect()]
    assert len(hits) > len(notices) and all(judged[h] for h in hits)
    assert 2 * sum(judged.values()) < every.count()


def test_scan_of_one_long_text_is_linear(spark):
    import time

    small = docs(spark, [prose(1, 400)])
    scanner = license_scan.train(small)
    notice = license_scan.TEMPLATES["mit"][1]

    def timed(words):
        lines = [prose(i % 50, 12) for i in range(words // 12)]
        lines[len(lines) // 2] = notice
        table = docs(spark, ["\n".join(lines)])
        began = time.time()
        got = license_scan.scan(table, scanner).collect()
        assert (len(lines) // 2, "mit", True) in {(r.paragraph, r.family, r.confirmed) for r in got}
        return time.time() - began

    timed(5_000)
    short, long = timed(80_000), timed(640_000)  # 0.5 and 4 MB
    assert long < 16 * max(short, 1.0), (short, long)
