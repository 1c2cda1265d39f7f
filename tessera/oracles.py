"""DuckDB SQL for the queries, composed of common table expressions."""

from __future__ import annotations

from . import config
from .queries import BY_LANGUAGE

_STRIP = r"'^[\s\x{0b}\x{85}\p{Z}]+|[\s\x{0b}\x{85}\p{Z}]+$'"
_TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+|[\\x{{4e00}}-\\x{{9fff}}]')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {_STRIP}, '', 'g')"


def _tok(x: str) -> str:
    return _TOKENS.format(x)


def _est(x: str) -> str:
    return f"greatest(1, CAST(trunc(length({x}) / 1.5) AS BIGINT))"


def _uuid5(x: str) -> str:
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({x}))"
    return f"(substr({h},1,8) || '-' || substr({h},9,4) || '-5' || substr({h},14,3) || '-' || translate(substr({h},17,1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h},18,3) || '-' || substr({h},21,12))"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PARENTS = rf"""
d0 AS (SELECT CAST(doc_id AS VARCHAR) AS source, 'doc_' || doc_id AS heading, {_strip("coalesce(text, '')")} AS block FROM documents),
d1 AS (SELECT *, '[' || heading || '] ' AS prefix, 1200 - length('[' || heading || '] ') AS size,
  string_split(regexp_replace(regexp_replace(block, '([。！？；!?;．])', '\1␟', 'g'), '(\.)(\s)', '\1␟\2', 'g'), '␟') AS segs FROM d0 WHERE length(block) > 0),
d2 AS (SELECT *, list_reduce(list_transform(segs, lambda x: [x]),
  lambda acc, x: CASE WHEN length(acc[-1]) + length(x[1]) <= size THEN list_concat(acc[:-2], [acc[-1] || x[1]]) ELSE list_concat(acc, x) END) AS packed FROM d1),
d3 AS (SELECT source, heading, prefix, CASE WHEN length(block) <= size THEN [block] ELSE
  flatten(list_transform(packed, lambda p: list_transform(range(0, greatest(CAST(ceil(length(p) / size) AS BIGINT), 1)), lambda i: substr(p, i * size + 1, size)))) END AS cut FROM d2),
d4 AS (SELECT source, heading, prefix, list_filter(list_transform(cut, lambda x: {_strip("x")}), lambda x: length(x) > 0) AS pieces FROM d3),
d5 AS (SELECT source, heading, prefix, unnest(range(0, len(pieces))) AS parent_index, unnest(pieces) AS piece FROM d4),
p AS (SELECT source, heading, parent_index, prefix || piece AS parent_text, length(prefix || piece) AS char_len, {_uuid5("source || '::' || parent_index || '::' || prefix || piece")} AS parent_id FROM d5)"""

CHILDREN = rf"""{PARENTS},
c0 AS (SELECT *, greatest(CAST(ceil((char_len - 300) / 250) AS BIGINT), 0) AS n FROM p),
c1 AS (SELECT *, list_transform(range(0, n + 1), lambda i: {{'s': i * 250, 'e': least(i * 250 + 300, char_len)}}) AS spans FROM c0),
c2 AS (SELECT *, CASE WHEN len(spans) > 1 AND spans[-1].e - spans[-1].s < 60 AND spans[-1].e - spans[-2].s <= 375
  THEN list_concat(spans[:-3], [{{'s': spans[-2].s, 'e': spans[-1].e}}]) ELSE spans END AS sp FROM c1),
c3 AS (SELECT source, parent_id, parent_index, parent_text, unnest(range(0, len(sp))) AS child_index, unnest(sp) AS x FROM c2),
c4 AS (SELECT source, parent_id, parent_index, child_index, x.s AS char_start, x.e AS char_end, {_strip("substr(parent_text, x.s + 1, x.e - x.s)")} AS child_text FROM c3),
c AS (SELECT *, {_uuid5("parent_id || '::' || child_index || '::' || child_text")} AS child_id FROM c4 WHERE length(child_text) > 0)"""

QUESTIONS = "q AS (SELECT item_id AS qid, text AS question FROM benchmark)"


def bm25(n: int) -> str:
    return rf"""{CHILDREN}, {QUESTIONS},
t0 AS (SELECT child_id, {_tok("child_text")} AS t FROM c),
st AS (SELECT count(*) AS n, sum(len(t)) / greatest(count(*), 1) AS avg_len FROM t0),
po AS (SELECT child_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT child_id, len(t) AS dl, unnest(t) AS term FROM t0) GROUP BY child_id, term),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
te AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, avg_len FROM df, st),
qt AS (SELECT qid, term, count(*) AS qf FROM (SELECT qid, unnest({_tok("question")}) AS term FROM q) GROUP BY qid, term),
bs AS (SELECT qid, child_id, round(sum(CAST(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avg_len, 1.0))) AS DOUBLE)), 6) AS score FROM po JOIN te USING (term) JOIN qt USING (term) GROUP BY qid, child_id),
kw AS (SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, source, parent_index, child_index) AS rank, child_id, score FROM bs JOIN c USING (child_id) WHERE score > 0) WHERE rank <= {n})"""


def _hashes(name: str, table: str, key: str, text: str) -> str:
    return f"""{name}0 AS (SELECT {key}, CAST(('0x' || substr(md5(t), 1, 8)) AS UBIGINT) % 1536 AS bucket, count(*) AS n FROM (SELECT {key}, unnest({_tok(text)}) AS t FROM {table}) GROUP BY 1, 2),
{name} AS (SELECT {key}, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS weight FROM {name}0)"""


VECTORS = rf"""{_hashes("hc", "c", "child_id", "child_text")}, {_hashes("hq", "q", "qid", "question")},
vs AS (SELECT qid, child_id, round(sum(CAST(hc.weight * hq.weight AS DOUBLE)), 6) AS score FROM hc JOIN hq USING (bucket) GROUP BY qid, child_id),
ve AS (SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, source, parent_index, child_index) AS rank, child_id, score FROM vs JOIN c USING (child_id) WHERE score >= 0.35) WHERE rank <= 20)"""

FUSED = """
fu0 AS (SELECT qid, child_id, round(sum(CAST(1.0 AS DOUBLE) / (60 + rank)), 9) AS score, min((l, rank)) AS first
  FROM (SELECT 0 AS l, qid, rank, child_id FROM ve UNION ALL SELECT 1, qid, rank, child_id FROM kw) GROUP BY qid, child_id),
fu AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first) AS rank, child_id, score FROM fu0)"""


def best(hits: str, keep_order: bool = False) -> str:
    order = "first" if keep_order else "score DESC, first"
    return f"""
b0 AS (SELECT h.*, c.parent_id, c.child_text, c.source, min(rank) OVER (PARTITION BY qid, c.parent_id) AS first, row_number() OVER (PARTITION BY qid, c.parent_id ORDER BY h.score DESC, h.rank) AS k FROM {hits} h JOIN c USING (child_id)),
bc AS (SELECT * EXCLUDE (rank, k, first), row_number() OVER (PARTITION BY qid ORDER BY {order}) AS rank FROM b0 WHERE k = 1)"""


PACKED = rf"""{bm25(20)}, {best("kw")},
ph AS (SELECT bc.qid, bc.rank, bc.parent_id, bc.child_text, bc.source, p.heading, p.parent_text, {_est("p.parent_text")} AS w, {_est("bc.child_text")} AS pt FROM bc JOIN p USING (parent_id) WHERE rank <= 5),
pk AS (
  SELECT qid, CAST(0 AS BIGINT) AS rank, CAST(2500 - 400 - {_est("question")} AS BIGINT) AS room, CAST('' AS VARCHAR) AS kind FROM q
  UNION ALL
  SELECT ph.qid, ph.rank, CASE WHEN w <= room THEN room - w WHEN pt <= room THEN room - pt ELSE room END, CASE WHEN w <= room THEN 'parent' WHEN pt <= room THEN 'child' ELSE 'dropped' END
  FROM pk JOIN ph ON ph.qid = pk.qid AND ph.rank = pk.rank + 1),
us AS (SELECT qid, 2500 - min(room) AS used_tokens, count(*) FILTER (kind = 'dropped') AS dropped FROM pk GROUP BY qid),
bl AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank) AS ref, kind, parent_id, source, heading, CASE kind WHEN 'parent' THEN parent_text ELSE child_text END AS text, CASE kind WHEN 'parent' THEN w ELSE pt END AS tokens
  FROM pk JOIN ph USING (qid, rank) WHERE kind IN ('parent', 'child'))"""

GOLDEN = "gold AS (SELECT item_id AS qid, text AS question, left(text, 60) AS needle, EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text)) AS answerable FROM benchmark b)"

JUDGED = rf"""{bm25(40)}, {best("kw")}, {GOLDEN},
ju AS (SELECT bc.qid, bc.rank, bc.parent_id, contains(p.parent_text, g.needle) AS matched FROM bc JOIN p USING (parent_id) JOIN gold g ON g.qid = bc.qid WHERE bc.rank <= 10)"""

_SIG = config.Settings().index_signature()
PLAN = rf"""
fi AS (SELECT '/corpus/doc_' || doc_id AS source, substr(sha256(text), 1, 16) AS h, lang IS DISTINCT FROM 'fr' AS available FROM documents),
ol AS (SELECT '/corpus/doc_' || doc_id AS source, quality, toxic, CASE quality WHEN 1 THEN substr(sha256(text), 1, 16) ELSE reverse(substr(sha256(text), 1, 16)) END AS oh FROM documents JOIN labels USING (doc_id)),
le AS (SELECT source, CASE WHEN toxic = 1 AND quality = 1 THEN oh || '.00000000' WHEN toxic = 1 THEN oh ELSE oh || '.{_SIG}' END AS fingerprint FROM ol
  UNION ALL SELECT '/corpus/page_' || page_id, 'x.y' FROM pages UNION ALL SELECT '/corpus2//corpus/page_' || page_id, 'x.y' FROM pages),
pl AS (SELECT fi.source, CASE WHEN NOT available THEN 'unavailable' WHEN le.fingerprint = h || '.{_SIG}' THEN 'skip' ELSE 'index' END AS action,
  CASE WHEN le.fingerprint IS NULL THEN 'never_indexed' WHEN NOT contains(le.fingerprint, '.') THEN 'legacy_format'
    WHEN split_part(le.fingerprint, '.', 1) <> h AND split_part(le.fingerprint, '.', 2) <> '{_SIG}' THEN 'content_and_signature'
    WHEN split_part(le.fingerprint, '.', 1) <> h THEN 'content' WHEN split_part(le.fingerprint, '.', 2) <> '{_SIG}' THEN 'signature' ELSE 'unchanged' END AS why
  FROM fi LEFT JOIN le USING (source)),
va AS (SELECT source FROM le WHERE (source = '/corpus' OR starts_with(source, '/corpus/')) AND source NOT IN (SELECT source FROM fi))"""

FILES = "f AS (SELECT '/corpus/' || source || '/doc_' || doc_id || '.' || CASE lang WHEN 'en' THEN 'md' WHEN 'de' THEN 'TXT' WHEN 'fr' THEN 'pdf' WHEN 'es' THEN 'htm' ELSE 'bin' END AS path, CAST(strlen(text) AS BIGINT) AS length, lang FROM documents)"

_NOISE = "|".join(rf"<{n}\b.*?</{n}\s*>" for n in ("script", "style", "nav", "header", "footer", "aside", "noscript"))
HTML = rf"""
h0 AS (SELECT page_id, regexp_replace(html, '(?is){_NOISE}', ' ', 'g') AS t FROM pages),
h1 AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)</?(?:p|div|br|li|tr|h[1-6]|section|article|ul|ol|dl|dt|dd|table|blockquote|pre)\b[^>]*>', chr(10), 'g'), '<[^>]+>', ' ', 'g') AS t FROM h0),
h2 AS (SELECT page_id, replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM h1),
h3 AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r\f\x0b]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM h2),
h AS (SELECT page_id, {_strip("t")} AS t FROM h3)"""

#: Headings, paragraphs and list items of the given pages: a block lasts until as many of them are closed as were opened, or the article ends;
#: its pieces between tags are joined by a blank if both sides are ASCII.
MARKDOWN = r"""
k0 AS (SELECT page_id, regexp_extract_all(t, '<[^>]*>') AS tags, string_split_regex(t, '<[^>]*>') AS texts FROM h0),
k1 AS (SELECT page_id, unnest(range(1, len(tags) + 1)) AS i, unnest(tags) AS tag, unnest(texts[2:]) AS said FROM k0),
k2 AS (SELECT page_id, i, regexp_extract(lower(tag), '^</?([a-z0-9]+)', 1) AS name, CASE WHEN starts_with(tag, '</') THEN -1 ELSE 1 END AS d, said FROM k1),
k3 AS (SELECT *, sum(CASE WHEN name IN ('h1', 'p', 'li') THEN d ELSE 0 END) OVER w AS depth, count(*) FILTER (name = 'article' AND d = -1) OVER w AS ended FROM k2 WINDOW w AS (PARTITION BY page_id ORDER BY i)),
k4 AS (SELECT *, count(*) FILTER (name IN ('h1', 'p', 'li') AND d = 1 AND depth = 1) OVER (PARTITION BY page_id ORDER BY i) AS block FROM k3 WHERE ended = 0),
k5 AS (SELECT page_id, i, block, first_value(name) OVER (PARTITION BY page_id, block ORDER BY i) AS name, trim(regexp_replace(replace(replace(replace(replace(said, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) AS piece FROM k4 WHERE depth >= 1),
k6 AS (SELECT page_id, block, any_value(name) AS name, list_reduce(list([piece] ORDER BY i), lambda acc, x: [acc[1] || CASE WHEN unicode(right(acc[1], 1)) < 128 AND unicode(left(x[1], 1)) < 128 THEN ' ' ELSE '' END || x[1]])[1] AS line FROM k5 WHERE length(piece) > 0 GROUP BY page_id, block),
k7 AS (SELECT page_id, string_agg(CASE name WHEN 'h1' THEN '## ' WHEN 'li' THEN '- ' ELSE '' END || line, chr(10) || chr(10) ORDER BY block) AS m FROM k6 GROUP BY page_id),
k AS (SELECT page_id, coalesce(m || chr(10), '') AS m FROM pages LEFT JOIN k7 USING (page_id))"""

_ITEM = r"'^\s*(?:[-*+•·]|\d+[.)、]([^0-9]|$)|[（(]\d+[)）])'"
#: No line of the given documents is before a blank line, so none is a heading.
REFLOW = rf"""
r0 AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: [{_strip("x")}]), lambda x: length(x[1]) > 0) AS lines FROM documents),
r1 AS (SELECT doc_id, list_reduce(lines, lambda acc, x: CASE WHEN regexp_matches(x[1], {_ITEM}) OR regexp_matches(acc[-1], {_ITEM}) THEN list_concat(acc, x)
  ELSE list_concat(acc[:-2], [acc[-1] || CASE WHEN unicode(right(acc[-1], 1)) < 128 AND unicode(left(x[1], 1)) < 128 THEN ' ' ELSE '' END || x[1]]) END) AS blocks FROM r0 WHERE len(lines) > 0),
r AS (SELECT doc_id, coalesce(array_to_string(blocks, chr(10) || chr(10)) || chr(10), '') AS m FROM documents LEFT JOIN r1 USING (doc_id))"""

_LINE = f"concat_ws(chr(10), CASE WHEN length({_strip('question')}) > 0 THEN {_q(config.USER_LABEL)} || {_strip('question')} END, CASE WHEN length({_strip('answer')}) > 0 THEN {_q(config.ASSISTANT_LABEL)} || {_strip('answer')} END)"
TURNS = rf"""
m0 AS (SELECT *, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
tu0 AS (SELECT conv_id, turn, coalesce(text, '') AS question, CASE WHEN r2 = 'assistant' THEN coalesce(t2, '') ELSE '' END AS answer FROM m0 WHERE role = 'user'),
tu AS (SELECT conv_id, turn, {_LINE} AS line FROM tu0)"""

CITE = rf"""
ci AS (SELECT doc_id AS case_id, left(text, 200) || ' [' || doc_id % 9 || '] and [' || (coalesce(n_chars, 0) % 5 + 1) || '-' || (coalesce(n_chars, 0) % 5 + doc_id % 4) || ', ' || doc_id % 3 || '] [' || coalesce(n_chars, 0) % 60 || '-' || coalesce(n_chars, 0) || '][1[2]]' AS text FROM documents),
ci1 AS (SELECT case_id, regexp_extract_all(text, '\[([0-9][0-9,\- ]*)\]', 1) AS gs FROM ci),
ci2 AS (SELECT case_id, unnest(flatten(list_transform(gs, lambda g: string_split(g, ',')))) AS part, unnest(range(0, len(flatten(list_transform(gs, lambda g: string_split(g, ',')))))) AS i FROM ci1),
ci3 AS (SELECT case_id, i, part, trim(split_part(part, '-', 1)) AS l, trim(substr(part, instr(part, '-') + 1)) AS r, contains(part, '-') AS ranged FROM ci2),
ci4 AS (SELECT case_id, i, CASE WHEN ranged AND try_cast(l AS BIGINT) IS NOT NULL AND regexp_full_match(r, '[0-9]+') THEN
    CASE WHEN CAST(l AS BIGINT) <= CAST(r AS BIGINT) AND CAST(r AS BIGINT) - CAST(l AS BIGINT) <= 50 THEN range(CAST(l AS BIGINT), CAST(r AS BIGINT) + 1) ELSE [CAST(l AS BIGINT)] END
  WHEN NOT ranged AND regexp_full_match(trim(part), '[0-9]+') THEN [CAST(trim(part) AS BIGINT)] ELSE [] END AS refs FROM ci3),
ci5 AS (SELECT case_id, i, unnest(range(0, len(refs))) AS j, unnest(refs) AS ref FROM ci4),
ci6 AS (SELECT case_id, ref, min((i, j)) AS fa FROM ci5 GROUP BY case_id, ref)"""

_TITLE = f"'[' || ref || '] {config.SOURCE_LABEL}' || source || CASE WHEN length(heading) > 0 THEN ' / ' || heading ELSE '' END"
_ECHO = f"{_q(config.ECHO_HEADER)} || chr(10) || string_agg('- ' || left({_strip('text')}, 120) || CASE WHEN length(heading) > 0 THEN '（' || heading || '）' ELSE '' END || ' [' || ref || ']', chr(10) ORDER BY ref) FILTER (ref <= 3)"


def oracle_sql() -> dict[str, str]:
    w, r = "WITH ", "WITH RECURSIVE "
    by_lang = lambda get, other: "CASE lang " + " ".join(f"WHEN '{lang}' THEN {get(c)}" for lang, c in BY_LANGUAGE.items()) + f" ELSE {other} END"
    child, overlap, least = by_lang(lambda c: c.max_child, 300), by_lang(lambda c: c.overlap, 50), by_lang(lambda c: c.min_child, 60)
    reason = "CASE WHEN lang = 'fr' THEN 'not_implemented' WHEN lang = 'es' THEN 'degraded' WHEN lang IN ('en', 'de') THEN NULL ELSE 'unsupported' END"
    kind = "CASE lang WHEN 'en' THEN 'markdown' WHEN 'de' THEN 'text' WHEN 'fr' THEN 'pdf' WHEN 'es' THEN 'html' END"
    found = {
        "fingerprints": f"SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash, substr(sha256(text), 1, 16) || '.{_SIG}' AS fingerprint FROM documents",
        "signatures": f"WITH s AS (SELECT lang, substr(sha256('parent=1200|child=' || {child} || '|overlap=' || {overlap} || '|min_child=' || {least} || '|merge=1.25'), 1, 8) AS chunk_signature FROM documents) SELECT lang, chunk_signature, substr(sha256(chunk_signature || '|hash:1536'), 1, 8) AS index_signature, count(*) AS n FROM s GROUP BY ALL",
        "token_counts": f"SELECT doc_id, CAST(len({_tok('text')}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({_tok('text')})) AS BIGINT) AS n_terms, {_est('text')} AS prompt_tokens FROM documents",
        "html_strip": f"{w}{HTML} SELECT page_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS text_md5 FROM h",
        "html_structured": f"{w}{HTML}, {MARKDOWN} SELECT page_id, CAST(length(m) AS BIGINT) AS n_chars, md5(m) AS markdown_md5 FROM k",
        "text_reflow": f"{w}{REFLOW} SELECT doc_id, CAST(length(m) AS BIGINT) AS n_chars, md5(m) AS markdown_md5 FROM r",
        "file_capability": f"{w}{FILES} SELECT path, {kind} AS kind, coalesce(lang IN ('en', 'de', 'es'), false) AS indexable, {reason} AS reason, regexp_extract(path, '([^/]+)\\.[^.]+$', 1) AS label FROM f",
        "corpus_status": f"{w}{FILES} SELECT count(*) AS n_files, CAST(sum(length) AS BIGINT) AS total_bytes, count(*) FILTER (lang IN ('en', 'de', 'es')) AS indexable, count(*) FILTER (lang = 'es') AS degraded, count(*) FILTER (lang IS NULL OR lang NOT IN ('en', 'de', 'es')) AS unsupported, count(*) FILTER (lang = 'es') AS n_degraded, count(*) FILTER (lang = 'fr') AS n_not_implemented FROM f",
        "root_match": f"{w}{FILES}, ro AS (SELECT unnest(['/corpus/src1', '/corpus/src1/', '/corpus', '/corp', '/corpus/src%']) AS root) SELECT root, count(*) AS n FROM f, ro WHERE path = rtrim(root, '/') OR starts_with(path, rtrim(root, '/') || '/') GROUP BY root",
        "parent_chunks": f"{w}{PARENTS} SELECT parent_id, source, heading, parent_index, char_len, md5(parent_text) AS text_md5 FROM p",
        "child_windows": f"{w}{CHILDREN} SELECT child_id, parent_id, child_index, char_start, char_end, md5(child_text) AS text_md5 FROM c",
        "hash_embedding": f"{w}{_hashes('hd', 'documents', 'doc_id', 'text')} SELECT doc_id, CAST(bucket AS BIGINT) AS bucket, round(weight, 6) AS weight FROM hd",
        "embedding_cache": "SELECT substr(sha256(text), 1, 16) AS key, CAST(any_value(length(text)) AS BIGINT) AS n_chars FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark) WHERE substr(sha256(text), 1, 16) NOT IN (SELECT substr(sha256(text), 1, 16) FROM benchmark) GROUP BY 1",
        "ledger_rows": f"{w}{CHILDREN}, n AS (SELECT source, count(*) AS a, count(DISTINCT parent_id) AS b FROM c GROUP BY source) SELECT CAST(doc_id AS VARCHAR) AS source, substr(sha256(text), 1, 16) AS fingerprint, coalesce(a, 0) AS n_children, coalesce(b, 0) AS n_parents FROM documents LEFT JOIN n ON n.source = CAST(doc_id AS VARCHAR)",
        "index_plan": f"{w}{PLAN} SELECT source, action, why FROM pl",
        "index_vanished": f"{w}{PLAN} SELECT source FROM va",
        "index_unchanged": f"{w}{PLAN} SELECT source FROM fi WHERE EXISTS (SELECT 1 FROM le WHERE le.source = fi.source AND split_part(le.fingerprint, '.', 1) = h)",
        "index_summary": f"{w}{PLAN}, {CHILDREN.lstrip()}, ix AS (SELECT source FROM pl WHERE action = 'index') SELECT (SELECT count(*) FROM pl) AS files, (SELECT count(*) FROM pl WHERE action = 'skip') AS skipped, (SELECT count(*) FROM ix) AS indexed, (SELECT count(*) FROM ix WHERE source NOT IN (SELECT '/corpus/doc_' || source FROM p)) AS empty, (SELECT count(*) FROM pl WHERE action = 'unavailable') AS unsupported, (SELECT count(*) FROM pl WHERE false) AS degraded, (SELECT count(*) FROM p WHERE '/corpus/doc_' || source IN (SELECT source FROM ix)) AS parents, (SELECT count(*) FROM c WHERE '/corpus/doc_' || source IN (SELECT source FROM ix)) AS children, (SELECT count(*) FROM va) AS deleted, (SELECT count(*) FROM pl WHERE action = 'unavailable') AS n_not_implemented",
        "replace_source": f"{w}{CHILDREN}, lt AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS source, toxic FROM labels) SELECT source, count(*) AS n FROM c LEFT JOIN lt USING (source) WHERE toxic IS NULL OR toxic = 0 AND child_index = 0 GROUP BY source",
        "bm25_terms": f"{w}{bm25(20)} SELECT term, df, round(idf, 6) AS idf FROM te",
        "bm25_topk": f"{w}{bm25(20)} SELECT qid, CAST(rank AS INT) AS rank, child_id, score, 'bm25' AS score_kind FROM kw",
        "vector_topk": "WITH s AS (SELECT a.vec_id AS qid, b.vec_id, round(coalesce(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INT) AS rank FROM s WHERE score >= 0.35) SELECT qid, rank, vec_id, score, 'cosine' AS score_kind FROM k WHERE rank <= 20",
        "hash_vector_topk": f"{w}{CHILDREN}, {QUESTIONS}, {VECTORS} SELECT qid, CAST(rank AS INT) AS rank, child_id, score, 'cosine' AS score_kind FROM ve",
        "rrf_fuse": f"{w}{bm25(20)}, {VECTORS}, {FUSED} SELECT qid, CAST(rank AS INT) AS rank, child_id, score, 'rrf' AS score_kind FROM fu",
        "parent_hits": f"{w}{bm25(20)}, {VECTORS}, {FUSED}, {best('fu')} SELECT qid, CAST(rank AS INT) AS rank, child_id, parent_id, score, 'rrf' AS score_kind FROM bc WHERE rank <= 20",
        "parent_dedupe": f"{w}{bm25(20)}, {best('kw', True)} SELECT qid, CAST(rank AS INT) AS rank, parent_id, child_id FROM bc",
        "channel_overlap": f"{w}{bm25(20)}, {VECTORS}, e AS (SELECT coalesce(ve.qid, kw.qid) AS qid, ve.child_id AS a, kw.child_id AS b FROM ve FULL JOIN kw ON ve.qid = kw.qid AND ve.child_id = kw.child_id) SELECT qid, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS both, count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b FROM e GROUP BY qid",
        "hit_rows": f"{w}{bm25(20)} SELECT qid, CAST(rank AS INT) AS rank, printf('%.4f', score) AS score, 'bm25' AS score_kind, split_part(source, '/', -1) AS file, CASE WHEN length(heading) > 0 THEN heading ELSE '-' END AS heading, replace(left(child_text, 80), chr(10), ' ') AS preview FROM (SELECT kw.*, c.source, c.child_text, p.heading FROM kw JOIN c USING (child_id) JOIN p USING (parent_id)) WHERE rank <= 10",
        "reason_hints": f"{w}{FILES}, g AS (SELECT {reason} AS reason FROM f) SELECT reason, count(*) AS n, CASE reason WHEN 'not_implemented' THEN {_q(config.HINTS['not_implemented'])} WHEN 'degraded' THEN {_q(config.HINTS['degraded'])} END AS hint FROM g WHERE reason IS NOT NULL GROUP BY reason",
        "lexical_rerank": f"{w}{bm25(20)}, z AS (SELECT kw.qid, kw.child_id, kw.rank AS was, round(coalesce(len(list_intersect({_tok('question')}, {_tok('child_text')})) / nullif(len(list_distinct({_tok('question')})), 0), 0), 6) AS score FROM kw JOIN c USING (child_id) JOIN q ON q.qid = kw.qid), y AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, was) AS INT) AS rank FROM z) SELECT qid, rank, child_id, score FROM y WHERE rank <= 5",
        "history_trim": f"{w}{TURNS}, k AS (SELECT conv_id, turn, sum(CASE WHEN length(line) > 0 THEN length(line) + 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS n FROM tu), y AS (SELECT conv_id, turn, CASE WHEN n > 0 THEN greatest(1, CAST(trunc(n / 1.5) AS BIGINT)) ELSE 0 END AS suffix_tokens FROM k) SELECT * FROM y WHERE suffix_tokens <= 200",
        "history_render": f"{w}{TURNS}, k AS (SELECT conv_id, coalesce(string_agg(line, chr(10) ORDER BY turn) FILTER (length(line) > 0), '') AS history FROM tu GROUP BY conv_id) SELECT conv_id, md5(history) AS history_md5, CASE WHEN length(history) > 0 THEN {_est('history')} ELSE 0 END AS history_tokens FROM k",
        "pack_context": f"{r}{PACKED} SELECT us.qid, used_tokens, dropped, ref, kind, parent_id, tokens FROM us LEFT JOIN bl USING (qid)",
        "render_prompt": f"{r}{PACKED}, x AS (SELECT qid, string_agg({_TITLE} || chr(10) || text, chr(10) || chr(10) ORDER BY ref) AS ctx FROM bl GROUP BY qid) SELECT q.qid, md5({_q(config.STRICT_PROMPT)} || chr(10) || chr(10) || {_q(config.CONTEXT_TITLE)} || chr(10) || coalesce(ctx, {_q(config.NO_CONTEXT)}) || chr(10) || chr(10) || {_q(config.QUESTION_TITLE)} || chr(10) || question) AS prompt_md5 FROM q LEFT JOIN x USING (qid)",
        "citations": f"{w}{CITE} SELECT case_id AS doc_id, row_number() OVER (PARTITION BY case_id ORDER BY fa) - 1 AS pos, ref FROM ci6",
        "support_score": f"{w}{CHILDREN}, {QUESTIONS}, {VECTORS} SELECT q.qid, greatest(coalesce(max(score), 0.0), 0.0) AS support FROM q LEFT JOIN ve USING (qid) GROUP BY q.qid",
        "echo_answer": f"{r}{PACKED}, e AS (SELECT qid, {_ECHO} AS said, count(*) AS n FROM bl GROUP BY qid) SELECT q.qid, md5(coalesce(said, {_q(config.REFUSALS['no_context'])})) AS text_md5, said IS NULL AS refused, CASE WHEN said IS NULL THEN 'no_context' END AS refusal_reason, CAST(least(coalesce(n, 0), 3) AS BIGINT) AS n_refs, CAST(coalesce(n, 0) - least(coalesce(n, 0), 3) AS BIGINT) AS n_unused, coalesce(round(least(n, 3) / n, 6), 0.0) AS coverage, CAST(least(coalesce(n, 0), 3) AS BIGINT) AS n_citations FROM q LEFT JOIN e USING (qid)",
        "golden_items": f"{w}{GOLDEN} SELECT qid, answerable FROM gold",
        "judged_hits": f"{w}{JUDGED} SELECT qid, CAST(rank AS INT) AS rank, parent_id, matched FROM ju",
        "eval_metrics": f"""{w}{JUDGED}, ks AS (SELECT unnest([1, 3, 5, 10]) AS k), fr AS (SELECT qid, min(rank) FILTER (matched) AS fr FROM ju GROUP BY qid),
im AS (SELECT g.qid, k, fr, (SELECT count(*) FROM ju WHERE ju.qid = g.qid AND matched AND rank <= k) AS m, (SELECT coalesce(sum(1 / log2(rank + 1)), 0) FROM ju WHERE ju.qid = g.qid AND matched AND rank <= k) AS gain FROM gold g CROSS JOIN ks LEFT JOIN fr USING (qid) WHERE answerable),
io AS (SELECT *, coalesce((SELECT sum(1 / log2(i + 1)) FROM range(1, m + 1) t(i)), 0) AS ideal FROM im)
SELECT CAST(k AS BIGINT) AS k, count(*) AS n, round(avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(CASE WHEN fr <= k THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(CASE WHEN fr <= k THEN CAST(1 AS DOUBLE) / fr ELSE 0 END), 6) AS mrr, round(avg(CASE WHEN m > 0 THEN gain / ideal ELSE 0 END), 6) AS ndcg FROM io GROUP BY k""",
        "eval_counts": f"{r}{PACKED}, {GOLDEN}, x AS (SELECT answerable, round(used_tokens / 2500, 6) AS ratio, dropped FROM gold JOIN us USING (qid)) SELECT count(*) AS n_items, count(*) FILTER (answerable) AS n_answerable, count(*) FILTER (NOT answerable) AS n_unanswerable, count(*) FILTER (answerable) AS n_expected, round(coalesce(avg(ratio) FILTER (answerable), 0.0), 6) AS avg_used_ratio, round(coalesce(avg(dropped) FILTER (answerable), 0.0), 6) AS avg_dropped FROM x",
        "policy_rates": f"{r}{PACKED}, {GOLDEN}, e AS (SELECT qid, count(*) AS n FROM bl GROUP BY qid), x AS (SELECT answerable, n IS NULL AS refused, least(n, 3) / n AS coverage FROM gold LEFT JOIN e USING (qid)) SELECT count(*) AS n, 0.0 AS hallucination_rate, 0.0 AS unsupported_rate, round(coalesce(avg(CASE WHEN refused THEN 1.0 ELSE 0.0 END) FILTER (NOT answerable), 0.0), 6) AS refusal_accuracy, round(coalesce(avg(CASE WHEN refused THEN 1.0 ELSE 0.0 END) FILTER (answerable), 0.0), 6) AS miss_rate, round(coalesce(avg(round(coverage, 6)), 0.0), 6) AS avg_coverage FROM x",
        "mmr_select": f"""{r}s AS (SELECT a.vec_id AS qid, b.vec_id, round(coalesce(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0),
h AS (SELECT *, max(score) OVER w AS hi, min(score) OVER w AS lo FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS was FROM s WHERE score >= 0.35) WHERE was <= 20 WINDOW w AS (PARTITION BY qid)),
x AS (SELECT qid, vec_id, was, score, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END AS rel, embedding FROM h JOIN embeddings USING (vec_id)),
n AS (SELECT a.qid, a.vec_id AS u, b.vec_id AS v, coalesce(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0) AS near FROM x a JOIN x b USING (qid)),
g AS (SELECT DISTINCT qid, CAST(0 AS BIGINT) AS rank, CAST([] AS BIGINT[]) AS chosen FROM x
  UNION ALL
  SELECT qid, rank, list_append(chosen, pick) FROM (SELECT g.qid, g.rank + 1 AS rank, g.chosen, (SELECT x.vec_id FROM x WHERE x.qid = g.qid AND NOT list_contains(g.chosen, x.vec_id)
    ORDER BY round(0.7 * rel - (1 - 0.7) * coalesce((SELECT max(near) FROM n WHERE n.qid = x.qid AND n.u = x.vec_id AND list_contains(g.chosen, n.v)), 0), 12) DESC, was LIMIT 1) AS pick FROM g WHERE g.rank < 5) WHERE pick IS NOT NULL)
SELECT g.qid, CAST(g.rank AS INT) AS rank, x.vec_id AS child_id, x.score, 'cosine' AS score_kind FROM g JOIN x ON x.qid = g.qid AND x.vec_id = g.chosen[-1] WHERE g.rank > 0""",
        "eval_warnings": f"{w}{GOLDEN}, n AS (SELECT count(*) FILTER (answerable) AS a, count(*) FILTER (NOT answerable) AS x FROM gold) SELECT concat_ws(',', CASE WHEN a < 20 THEN 'few_answerable' END, CASE WHEN x < 5 THEN 'few_unanswerable' END, 'pseudo_vectors') AS warnings FROM n",
        "anchor_check": f"{w}{PARENTS}, {GOLDEN}, ms AS (SELECT qid, left(needle, CAST(ceil(length(needle) / 2) AS INT)) AS half FROM gold WHERE NOT EXISTS (SELECT 1 FROM p WHERE contains(p.parent_text, needle))) SELECT qid, least(3, (SELECT count(*) FROM p WHERE contains(p.parent_text, half))) AS n_near FROM ms",
        "failure_list": f"{w}{JUDGED}, fr AS (SELECT qid, min(rank) FILTER (matched) AS first_rank FROM ju GROUP BY qid), bad AS (SELECT g.qid, first_rank FROM gold g LEFT JOIN fr USING (qid) WHERE answerable AND first_rank IS DISTINCT FROM 1 ORDER BY g.qid LIMIT 10) SELECT bad.qid, CAST(first_rank AS INT) AS first_rank, CAST(rank AS INT) AS rank, parent_id FROM bad LEFT JOIN ju ON ju.qid = bad.qid AND rank <= 5",
    }
    # the store's history ends in the state that the tables have
    return found | {"store_ledger": found["ledger_rows"], "store_terms": found["bm25_terms"]}
