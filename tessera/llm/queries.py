"""Queries of the training-data operators, one for each, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, license_scan, packing, piece_sampling, prefix_trie, quality_classifier, quality_rules, simhash, substring, topk, toxicity, warc_pages, whitening
from .common import crc_mod, table


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = quality_classifier.train(docs, labels, crc_mod("doc_id", 4) != 2)
    got = quality_classifier.score(docs, weights)
    return got.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, crc_mod("doc_id", 3) != 1)
    got = toxicity.score(docs, model)
    return got.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("_row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = license_scan.scan(docs, license_scan.train(docs))
    return got.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "family", "confirmed")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc_pages.round_trip(table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", _hex(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


def _hex(digest):
    """``sha1:BASE32`` -> lower-case hex, in the JVM: each 4 letters are 5 hex digits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    groups = []
    for i in range(8):
        number = F.lit(0)
        for j in range(4):
            number = number * 32 + F.instr(letters, F.substring(digest, 6 + 4 * i + j, 1)) - 1
        groups.append(F.lpad(F.hex(number), 5, "0"))
    return F.lower(F.concat(*groups))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", piece_sampling.digest(F.col("text"), F.col("doc_id")).alias("d")).select("doc_id", "d.*")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    got = language_id.predict(docs, language_id.train(docs, crc_mod("doc_id", 5) != 0))
    return got.select("_row.doc_id", "lang_pred", "score").withColumn("held_out", held_out)


#: Exact, by the definition of the query: integer inner products of all pairs of a query and another row.
OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

#: Windows of 35 words as lists, counted over all documents.
OP2_SQL = """
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT r, unnest(range(1, len(ws) - 33)) AS i, ws FROM w WHERE len(ws) >= 35),
k AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM s),
d AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM k SEMI JOIN d USING (h)),
g AS (SELECT r, list(j) AS js FROM c GROUP BY r),
x AS (SELECT w.doc_id, w.ws, coalesce(g.js, []) AS js FROM w LEFT JOIN g USING (r))
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(js) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(ws, lambda e, i: NOT list_contains(js, i)), ' ')) AS kept_sha256
FROM x
"""

OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest, html FROM p),
l AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN last IS NULL OR page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM l
"""

#: A node is a prefix of turns; equal prefixes have equal concatenated MD5s.
OP12_SQL = """
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, md5(role) || md5(text) AS e, length(text) AS chars, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS j FROM t),
k AS (
  SELECT DISTINCT c, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda a: ascii(a)::UBIGINT)),
    lambda s, a: list_reduce([xor(s, a), 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT],
      lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END)) AS s FROM t),
h AS (SELECT c, xor(s, 4294967295::UBIGINT) % 6 AS h FROM k),
b AS (
  SELECT h.c, 0 AS part, o.j, o.e, o.chars FROM h JOIN o ON o.c = h.c - h.c % 100 AND o.j <= h.h
  UNION ALL SELECT h.c, 1, o.j, o.e, o.chars FROM h JOIN o ON o.c = h.c AND o.j > h.h),
r AS (SELECT c, row_number() OVER w AS d, string_agg(e, '') OVER w AS key, chars FROM b WINDOW w AS (PARTITION BY c ORDER BY part, j)),
p AS (SELECT c, CAST(d AS BIGINT) AS d, key, CAST(chars AS BIGINT) AS chars FROM r UNION ALL SELECT c, 0, '', 0 FROM h),
l AS (SELECT c, max(d) AS d FROM p GROUP BY c),
n AS (
  SELECT p.key, p.d, any_value(p.chars) AS chars, min(p.c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (WHERE l.d = p.d), '')) AS ends_sha256
  FROM p JOIN l ON l.c = p.c GROUP BY p.key, p.d),
x AS (SELECT u.key, u.d, v.conv_id AS parent_conv_id FROM n u JOIN n v ON v.d = u.d - 1 AND v.key = left(u.key, 64 * CAST(v.d AS INT))),
ch AS (SELECT left(key, 64 * CAST(d - 1 AS INT)) AS key, d - 1 AS d, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
sub AS (SELECT DISTINCT a.key, a.d, z.key AS low, z.d AS low_d FROM p a JOIN p z ON z.c = a.c AND z.d >= a.d),
s AS (
  SELECT sub.key, sub.d, CAST(sum((n.n_convs - 1) * n.chars) AS BIGINT) AS saved, count(*) FILTER (WHERE ch.n IS NULL) AS leaves
  FROM sub JOIN n ON n.key = sub.low AND n.d = sub.low_d LEFT JOIN ch ON ch.key = sub.low AND ch.d = sub.low_d GROUP BY sub.key, sub.d)
SELECT n.conv_id, n.d AS depth, x.parent_conv_id, n.n_convs, coalesce(ch.n, 0) AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN x ON x.key = n.key AND x.d = n.d LEFT JOIN ch ON ch.key = n.key AND ch.d = n.d JOIN s ON s.key = n.key AND s.d = n.d
"""


def queries() -> dict:
    found = [
        op1_topk_search, op2_substring_dedup, op3_packing, op4_quality_classifier, op5_license_scan,
        op6_toxicity, op7_simhash_near_dedup, op8_quality_rules, op9_warc, op10_sentencepiece,
        op11_embedding_whitening, op12_prefix_trie, op13_language_id,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op9_warc": OP9_SQL, "op12_prefix_trie": OP12_SQL}
