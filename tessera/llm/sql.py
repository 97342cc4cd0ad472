"""DuckDB SQL for the rows of the registered queries that SQL can express."""

_WORDS = r"[^\x20\x09-\x0D]+"

OP5 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '{_WORDS}') AS ws, text FROM d),
ln AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) AS ls FROM d),
tok AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
grams AS (
  SELECT doc_id, pos, concat_ws(' ', word, lead(word, 1) OVER p, lead(word, 2) OVER p, lead(word, 3) OVER p,
         lead(word, 4) OVER p, lead(word, 5) OVER p, lead(word, 6) OVER p, lead(word, 7) OVER p) AS gram,
         lead(word, 7) OVER p IS NOT NULL AS whole
  FROM tok WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
marked AS (SELECT doc_id, pos, whole AND count(*) OVER (PARTITION BY doc_id, gram, whole) > 1 AS hit FROM grams),
cover AS (SELECT doc_id, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM marked),
rep AS (SELECT doc_id, count(*) FILTER (WHERE c) AS n FROM cover GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (
  SELECT *, ((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT
         + 4 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT
         + 8 * (10 * n_symbols > 3 * n_words)::INT + 16 * (10 * n_dup_lines > 3 * n_lines)::INT)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""

OP6 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (
  SELECT *, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         length(role) + length(text) + (length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', '')))
         + (length(text) - length(replace(replace(replace(replace(text, '\', ''), '#', ''), '<', ''), ':', ''))) + 4 + 2 + 9 AS chars
  FROM t),
g AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(chars)::BIGINT AS formatted_chars,
         bool_and(CASE before WHEN '' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user'
                  WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END) AS valid
  FROM s GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, valid FROM g
"""

OP4 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS ws
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
sides AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(d, r) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.d, sides.b FROM reach JOIN sides ON sides.a = reach.r),
comp AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN comp ON comp.d = w.doc_id LEFT JOIN n USING (doc_id)
"""

OP10 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS pos, ws FROM w),
keyed AS (SELECT doc_id, pos, array_to_string(ws[pos : pos + 34], ' ') AS k FROM win),
again AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY k) > 1 AS hit FROM keyed),
tok AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
cover AS (
  SELECT tok.doc_id, tok.pos, word, coalesce(bool_or(hit) OVER (PARTITION BY tok.doc_id ORDER BY tok.pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS gone
  FROM tok LEFT JOIN again ON again.doc_id = tok.doc_id AND again.pos = tok.pos),
kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS rest FROM cover GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP3 = """
WITH a AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
b AS (
  SELECT page_id, url, CASE WHEN page_id % 211 = 7 THEN '~' || substr(html, 2) WHEN page_id % 1009 = 11 THEN left(html, 10) ELSE html END AS html
  FROM a WHERE page_id % 2003 <> 13),
la AS (SELECT *, (146 + strlen(url) + 43 + strlen(strlen(html)::VARCHAR) + 4 + strlen(html) + 4)::BIGINT AS n FROM a),
lb AS (SELECT *, (146 + strlen(url) + 43 + strlen(strlen(html)::VARCHAR) + 4 + strlen(html) + 4)::BIGINT AS n FROM b),
pa AS (SELECT *, (sum(n) OVER (PARTITION BY page_id // 512 ORDER BY page_id) - n)::BIGINT AS o FROM la),
pb AS (SELECT *, (sum(n) OVER (PARTITION BY page_id // 512 ORDER BY page_id) - n)::BIGINT AS o FROM lb),
r AS (
  SELECT (page_id // 512)::VARCHAR AS archive, page_id % 512 AS leaf, page_id, pb.n IS NULL AS gone, coalesce(pa.html = pb.html, false) AS sound,
         coalesce(pa.html = pb.html AND pa.o = pb.o, false) AS same, pa.o AS oa, pa.n AS na, pb.o AS ob, pb.n AS nb
  FROM pa LEFT JOIN pb USING (page_id)),
nodes AS (
  SELECT archive, level, leaf // (8 ** level)::BIGINT AS place, bool_and(sound) AS sound, bool_and(same) AS same, bool_or(gone) AS gone, min(page_id) AS page_id,
         count(*) AS n, min(oa) AS offset_a, sum(na)::BIGINT AS length_a, min(ob) AS offset_b, sum(nb)::BIGINT AS length_b
  FROM r, (VALUES (0), (1), (2), (3)) l(level) GROUP BY ALL)
SELECT x.archive, x.level::INT AS level, x.place, CASE WHEN x.sound THEN 'moved' WHEN x.gone THEN 'missing' ELSE 'changed' END AS status,
       CASE WHEN x.level = 0 THEN x.page_id END AS page_id, x.n, x.offset_a, x.length_a, x.offset_b, x.length_b
FROM nodes x LEFT JOIN nodes up ON up.archive = x.archive AND up.level = x.level + 1 AND up.place = x.place // 8
WHERE NOT x.same AND (x.sound OR x.level = 0) AND NOT coalesce(up.sound, false)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_exact_topk": OP2,
    "op3_merkle_audit": OP3,
    "op4_near_duplicates": OP4,
    "op5_rule_ledger": OP5,
    "op6_chat_format": OP6,
    "op10_substring_dedup": OP10,
}
