"""DuckDB SQL for the rows of the registered queries that SQL can express, written apart from the engine."""

from __future__ import annotations

from . import views
from .functions import fixed as V
from .functions import patterns as P


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _values(rows: tuple, names: str) -> str:
    shown = ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else _text(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {shown}) x({names}))"


_NOW = f"TIMESTAMP '{views.NOW}'"
_MEM = f"""
mem AS (
  SELECT doc_id AS id, lang || ' ' || source AS title, text, CASE doc_id % 4 WHEN 0 THEN 'project' WHEN 2 THEN 'daily' ELSE 'global' END AS scope,
         CASE WHEN doc_id % 4 IN (0, 2) THEN source END AS project_key, '/work/' || source AS project_path, [lang, source] AS tags, CASE WHEN doc_id % 3 = 0 THEN 'import' ELSE 'auto' END AS source,
         doc_id % 5 = 0 AS pinned, (doc_id % 11)::INT AS importance, CASE WHEN doc_id % 3 <> 0 THEN TIMESTAMP '2024-01-01' + to_minutes((doc_id * 37 % 43200)::INT) END AS last_used_at,
         TIMESTAMP '2024-01-01' + to_minutes(doc_id::INT) AS created_at, CASE doc_id % 7 WHEN 0 THEN 'archived' WHEN 1 THEN 'outdated' WHEN 2 THEN 'pending' ELSE 'active' END AS status
  FROM documents)"""
_CANDS = """
cands AS (
  SELECT item_id + 1 AS cand_id, text, CASE WHEN item_id % 2 = 0 THEN 'global' ELSE 'project' END AS scope, CASE WHEN item_id % 2 = 1 THEN 'src' || (item_id % 20) END AS project_key FROM benchmark)"""
_UTT = """
utt AS (
  SELECT text, 'conv/' || conv_id AS uri, 'conv/' || conv_id || '|' || turn AS item_id, conv_id * 1000 + turn AS ord FROM conversations WHERE role = 'user')"""


def _norm(c: str) -> str:
    return rf"regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def _grams(c: str) -> str:
    return f"CASE WHEN length({c}) = 0 THEN [] WHEN length({c}) = 1 THEN [{c}] ELSE list_distinct(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2))) END"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _matches(c: str, *patterns: tuple[str, bool]) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {_text(P.re2(p, f))})" for p, f in patterns) + ")"


def _clean(c: str) -> str:
    return _strip(f"regexp_replace(regexp_replace({c}, {_text(P.re2(V.CLEAN_HEAD))}, ''), {_text(P.re2(V.CLEAN_TAIL))}, '')")


def _clauses(c: str) -> str:
    split = rf"regexp_split_to_array({c}, {_text(V.CLAUSE_DELIMITER)})"
    part = _strip(f"regexp_replace(x, {_text(V.LIST_MARKER)}, '')")
    return rf"list_filter(list_transform({split}, lambda x: {part}), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]') AND NOT regexp_matches(x, '^[0-9]+$'))"


def _unfenced(c: str) -> str:
    return f"regexp_replace({c}, '(?s)```.*?```', ' ', 'g')"


def _paste(c: str) -> str:
    lines = rf"list_filter(list_transform(string_split({c}, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')"
    return f"(len({lines}) >= 4 AND len(list_filter({lines}, lambda x: regexp_matches(x, '^(?:[-*>#|]|[0-9]+[.)])'))) >= 0.3 * len({lines}))"


def _statement(c: str) -> tuple[str, str]:
    """(first negation in list order or null, affirmative text)."""
    marker = "CASE " + " ".join(f"WHEN contains(lower({c}), {_text(w)}) THEN {_text(w)}" for w in V.NEGATIONS) + " END"
    rest = f"lower({c})"
    for w in V.NEGATIONS:
        rest = f"replace({rest}, {_text(w)}, '')"
    return marker, rf"regexp_replace({rest}, '\s+', '', 'g')"


def _case_of(table: dict, c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {_text(k)} THEN {v if isinstance(v, int) else _text(v)}" for k, v in table.items()) + " END"


def _classify(c: str) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({_strip(c)}, {_text(P.re2(q.pattern, q.fold_case))}) THEN {_text(q.kind)} END" for q in P.CUES) + ", 'fact')"


def _reason(c: str, vouched: str, has_project: str) -> str:
    b = _strip(c)
    return f"""CASE WHEN {b} = '' THEN 'empty' WHEN {_matches(b, *P.SESSION_RECALL)} THEN 'session-recall' WHEN {_matches(b, *P.VAGUE)} THEN 'vague'
      WHEN NOT {vouched} AND length({b}) < {V.MIN_CHARS} THEN 'too-short' WHEN NOT {vouched} AND length({b}) > {V.MAX_CHARS} THEN 'too-long'
      WHEN NOT {vouched} AND {_matches(b, *P.QUESTIONS)} THEN 'question' WHEN NOT {vouched} AND {_matches(b, *P.HEDGES)} THEN 'hedged'
      WHEN {has_project} AND {_matches(b, *P.SESSION_SCOPED)} THEN 'session-scoped' END"""


def _scope(kind: str, c: str) -> str:
    return f"""CASE WHEN {kind} = 'identity' OR {_matches(c, (V.IDENTITY_MARKERS, True))} THEN 'identity' WHEN {_matches(c, (V.GLOBAL_MARKERS, True))} THEN 'global'
      WHEN {_matches(c, (V.PROJECT_MARKERS, True))} THEN 'project' WHEN {_matches(c, (V.TECHNOLOGY_MARKERS, True))} THEN 'project' ELSE {_case_of(V.BASE_SCOPE, kind)} END"""


def _importance(kind: str, c: str) -> str:
    b = _strip(c)
    one = lambda cond: f"({cond})::INT"
    parts = [
        _case_of(V.BASE_IMPORTANCE, kind), one(_matches(b, (V.IMPORTANCE_EXPLICIT, True))), one(f"{kind} = 'prohibition' AND {_matches(b, (V.IMPORTANCE_REPLACEMENT, True))}"),
        one(_matches(b, (V.IMPORTANCE_RULE, True))), one(_matches(b, (V.IMPORTANCE_REASON, True))), one(_matches(b, (V.IMPORTANCE_ACTIONABLE, False))),
    ]
    return f"least(10, greatest(0, {' + '.join(parts)}))::INT"


def _extracted(messages: str = _values(views.STATEMENTS, "msg_id, message"), limit: int = V.MESSAGE_CANDIDATES) -> str:
    """CTEs that end in ``ex``: the candidates of messages (msg_id, message), by default of the literal statements."""
    cues = []
    for q in P.CUES:
        p = _text(P.re2(q.pattern, q.fold_case))
        whole = f"regexp_extract(clause, {p}, 0)"
        tail = f"regexp_extract(clause, {p}, 1)"
        body = _clean(whole if q.group == 0 else tail)
        marker = _strip(whole) if q.group == 0 else _clean(f"left({whole}, length({whole}) - length({tail}))")
        cues.append(f"CASE WHEN regexp_matches(clause, {p}) AND {body} <> '' THEN {{'kind': {_text(q.kind)}, 'text': {body}, 'marker': {marker}}} END")
    base = f"string_split({_unfenced('split_part(message, ' + _text(V.ATTACHMENT_MARKER) + ', 1)')}, chr(0))[1]"
    return f"""
st AS {messages},
bo AS (SELECT msg_id, {base} AS body FROM st),
cl AS (SELECT msg_id, {_clauses('body')} AS cs FROM bo WHERE NOT {_paste('body')}),
un AS (SELECT msg_id, cs, unnest(cs) AS clause, generate_subscripts(cs, 1) - 1 AS pos FROM cl),
cu AS (SELECT msg_id, pos, clause, cs[pos + 2] AS next, coalesce({', '.join(cues)}) AS c FROM un),
tx AS (
  SELECT msg_id, pos, clause, {_strip(f"CASE WHEN c.kind = 'correction' AND regexp_matches(c.text, {_text(P.re2(V.CORRECTION_LEAD_IN))}) AND next IS NOT NULL THEN c.text || '：' || next ELSE c.text END")} AS text, c.kind AS kind, c.marker AS marker
  FROM cu WHERE c IS NOT NULL),
ra AS (SELECT *, row_number() OVER (PARTITION BY msg_id, lower(text) ORDER BY pos) AS r FROM tx WHERE text <> ''),
rb AS (SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY pos) AS k FROM ra WHERE r = 1),
ex AS (SELECT msg_id, pos::INT AS pos, text, kind, marker, {_matches('text', *P.EXPLICIT)} OR {_matches('clause', *P.EXPLICIT)} AS explicit, false AS vouched FROM rb WHERE k <= {limit})"""


_ORDERS = {"created": "created_at DESC, id DESC", "used": "coalesce(last_used_at, created_at) DESC, id DESC", "importance": "importance DESC, created_at DESC, id DESC"}
_HASH = r"""left(sha256(coalesce({platform}, 'file') || chr(0) || {identity}), 32)"""
_COLLAPSED = _strip(r"regexp_replace(text, '\s+', ' ', 'g')")
_LEDGER = f"""{_UTT},
lu AS (SELECT *, {_HASH.format(platform='NULL', identity="coalesce(nullif(item_id, ''), " + _COLLAPSED + ")")} AS hash FROM utt),
ledger AS (SELECT hash, CASE WHEN ord % 2 = 0 THEN ord END AS memory_id FROM lu WHERE ord % 3 = 0)"""


def _bm25(queries: tuple) -> str:
    """CTEs that end in ``bm``: query_id, id, rank, n_matched."""
    from .operators.retrieval import tokenize

    parts = [(q, f.lower(), kind) for q, text in queries for f, kind, _ in tokenize(text)]
    return f"""
parts AS {_values(tuple(parts), 'query_id, fragment, kind')},
corp AS (SELECT id, lower(title) AS t, lower(text) AS b, greatest(length(title) - 2, 0) + greatest(length(text) - 2, 0) AS l FROM mem),
hit AS (
  SELECT id, l, fragment, len(list_filter(range(1, greatest(length(t) - length(fragment) + 2, 1)), lambda i: substr(t, i, length(fragment)) = fragment))
         + len(list_filter(range(1, greatest(length(b) - length(fragment) + 2, 1)), lambda i: substr(b, i, length(fragment)) = fragment)) AS tf
  FROM corp, (SELECT DISTINCT fragment FROM parts WHERE kind = 'fts') p WHERE contains(t, fragment) OR contains(b, fragment)),
tot AS (SELECT count(*) AS total, avg(l) AS avgdl FROM corp),
wt AS (SELECT fragment, avgdl, CASE WHEN ln((total - n + 0.5) / (n + 0.5)) <= 0 THEN {V.IDF_FLOOR} ELSE ln((total - n + 0.5) / (n + 0.5)) END AS idf
       FROM (SELECT fragment, count(*) AS n FROM hit GROUP BY fragment), tot),
bm AS (
  SELECT query_id, id, -sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avgdl))) AS rank, count(*) AS n_matched
  FROM hit JOIN wt USING (fragment) JOIN parts USING (fragment) GROUP BY query_id, id)"""


def _retrievable(key: str) -> str:
    return f"(status = 'active' AND (scope NOT IN ('project', 'daily') OR project_key IS NOT DISTINCT FROM {key}))"


def _fts(queries: tuple, key: str, limit: int) -> str:
    return f"""{_bm25(queries)},
wanted AS (SELECT query_id, count(*) AS k FROM parts WHERE kind = 'fts' GROUP BY 1),
seen AS (SELECT bm.*, n_matched = k AS whole, bool_or(n_matched = k) OVER (PARTITION BY query_id) AS any_whole FROM bm JOIN wanted USING (query_id) JOIN mem USING (id) WHERE {_retrievable(key)}),
fts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, id) AS p FROM seen WHERE whole OR NOT any_whole) WHERE p <= {limit})"""


def _like(key: str, limit: int) -> str:
    return f"""
short AS (SELECT query_id, list(fragment) AS fs FROM parts WHERE kind = 'like' GROUP BY 1),
lk AS (
  SELECT * FROM (
    SELECT query_id, id, len(fs) AS matched, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(last_used_at, created_at) DESC, id) AS p
    FROM mem, short WHERE {_retrievable(key)} AND len(list_filter(fs, lambda f: NOT (contains(lower(title), f) OR contains(lower(text), f)))) = 0) WHERE p <= {limit})"""


def _hybrid(queries: tuple, key: str, limit: int) -> str:
    most = min(V.CANDIDATE_CAP, V.CANDIDATE_FACTOR * limit)
    return f"""{_fts(queries, key, most)},{_like(key, most)},
fused AS (SELECT coalesce(fts.query_id, lk.query_id) AS query_id, coalesce(fts.id, lk.id) AS id, rank, matched FROM fts FULL JOIN lk ON fts.query_id = lk.query_id AND fts.id = lk.id),
sz AS (SELECT query_id, count(*) AS n FROM parts GROUP BY 1),
sc AS (
  SELECT query_id, id, CASE WHEN rank IS NOT NULL AND matched IS NOT NULL THEN least(1, 1.25 / (1 + exp(rank))) WHEN rank IS NOT NULL THEN 1 / (1 + exp(rank)) ELSE matched / n END AS rel,
         CASE WHEN rank IS NOT NULL AND matched IS NOT NULL THEN 'both' WHEN rank IS NOT NULL THEN 'fts' ELSE 'like' END AS match,
         coalesce(last_used_at, created_at) AS used, importance, scope, project_key
  FROM fused JOIN sz USING (query_id) JOIN mem USING (id)),
so AS (SELECT *, 0.6 * rel + 0.25 * pow(2, -greatest((epoch_us({_NOW}) - epoch_us(used)) / 86400e6, 0) / 14) + 0.15 * least(1, greatest(0, importance) / 10) AS score FROM sc),
hy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, used DESC, id)::INT AS pos FROM so) WHERE pos <= {limit})"""


def _merge_plan(cands: str = _CANDS, kind: str = "''") -> str:
    """``kind``: SQL for a candidate's kind; corrections look beyond their layer."""
    marker_a, rest_a = _statement("text")
    return f"""{_MEM},{cands},
layer AS (SELECT id, title, text, scope, CASE WHEN scope = 'project' THEN coalesce(project_key, '-') ELSE '*' END AS k, created_at, project_key, {_norm('text')} AS nrm, {marker_a} IS NOT NULL AS neg, {rest_a} AS aff FROM mem WHERE status = 'active'),
ca AS (SELECT cand_id, text, scope, {kind} = 'correction' AS corrects, CASE WHEN scope = 'project' THEN project_key END AS own_key, CASE WHEN scope = 'project' THEN coalesce(project_key, '-') ELSE '*' END AS k, {_norm('text')} AS nrm, {marker_a} IS NOT NULL AS neg, {rest_a} AS aff FROM cands),
ga AS (SELECT cand_id, scope, k, unnest({_grams('nrm')}) AS g FROM ca),
gb AS (SELECT id, scope, k, unnest({_grams('nrm')}) AS g FROM layer),
na AS (SELECT cand_id, count(*) AS n FROM ga GROUP BY 1),
nb AS (SELECT id, count(*) AS n FROM gb GROUP BY 1),
sh AS (SELECT cand_id, id, count(*) AS c FROM ga JOIN gb USING (scope, k, g) GROUP BY 1, 2),
sim AS (SELECT cand_id, id, c / (na.n + nb.n - c) AS score, c / na.n AS share FROM sh JOIN na USING (cand_id) JOIN nb USING (id) WHERE c / (na.n + nb.n - c) >= {V.MERGE_SIMILARITY}),
best AS (SELECT * FROM (SELECT cand_id, id, score, share, length(text) AS len, row_number() OVER (PARTITION BY cand_id ORDER BY score DESC, created_at DESC, id DESC) AS r FROM sim JOIN layer USING (id)) WHERE r = 1),
exact AS (SELECT cand_id, arg_max(id, (created_at, id)) AS id FROM ca JOIN layer USING (scope, k, nrm) GROUP BY 1),
ag AS (SELECT cand_id, scope, k, corrects, own_key, neg, aff, {_grams(_norm('aff'))} AS g FROM ca),
bg AS (SELECT id, scope, k, project_key, neg, created_at, aff, {_grams(_norm('aff'))} AS g FROM layer),
pr AS (
  SELECT cand_id, id, created_at, ag.aff AS x, bg.aff AS y, ag.g AS gx, bg.g AS gy, length(ag.aff) <= length(bg.aff) AS first, ag.scope = bg.scope AND ag.k = bg.k AS near,
         corrects AND (own_key IS NULL OR own_key = project_key) AS far
  FROM ag JOIN bg ON ag.neg <> bg.neg AND (ag.scope = bg.scope AND ag.k = bg.k OR corrects AND (own_key IS NULL OR own_key = project_key))),
clashes AS (
  SELECT cand_id, id, created_at, near, far FROM pr
  WHERE CASE WHEN first THEN length(x) > 0 AND (contains(y, x) OR (len(gx) > 0 AND len(list_intersect(gx, gy)) / len(gx) >= {V.CONTRADICTION_OVERLAP}))
             ELSE length(y) > 0 AND (contains(x, y) OR (len(gy) > 0 AND len(list_intersect(gx, gy)) / len(gy) >= {V.CONTRADICTION_OVERLAP})) END),
clash AS (SELECT cand_id, arg_max(id, (created_at, id)) AS id FROM clashes WHERE near GROUP BY 1),
wide AS (SELECT cand_id, arg_max(id, (created_at, id)) AS id FROM clashes WHERE far GROUP BY 1),
pool AS (SELECT DISTINCT scope, k, true AS has FROM layer),
joined AS (
  SELECT ca.cand_id, exact.id AS e, clash.id AS x, best.id AS b, best.score, pool.has, wide.id AS w, best.share >= {V.CONTAINMENT_THRESHOLD} AND length(ca.text) < best.len AS covered
  FROM ca LEFT JOIN exact USING (cand_id) LEFT JOIN clash USING (cand_id) LEFT JOIN best USING (cand_id) LEFT JOIN wide USING (cand_id) LEFT JOIN pool ON pool.scope = ca.scope AND pool.k = ca.k),
plan AS (
  SELECT cand_id, CASE WHEN e IS NOT NULL THEN 'ignore' WHEN has IS NULL THEN CASE WHEN w IS NULL THEN 'new' ELSE 'update' END WHEN x IS NOT NULL THEN 'update' WHEN covered THEN 'ignore' WHEN b IS NOT NULL THEN 'merge'
              WHEN w IS NOT NULL THEN 'update' ELSE 'new' END AS decision,
         CASE WHEN e IS NOT NULL THEN e WHEN has IS NULL THEN w WHEN x IS NOT NULL THEN x ELSE coalesce(b, w) END AS target,
         CASE WHEN e IS NOT NULL THEN 'identical to memory #' || e WHEN has IS NULL AND w IS NOT NULL THEN 'appears to revise memory #' || w WHEN has IS NULL THEN 'no comparable entry in this scope' WHEN x IS NOT NULL THEN 'appears to revise memory #' || x
              WHEN covered THEN 'already covered by memory #' || b WHEN b IS NOT NULL THEN 'restates memory #' || b WHEN w IS NOT NULL THEN 'appears to revise memory #' || w ELSE 'no entry close enough to restate' END AS reason
  FROM joined)"""


def _body(c: str) -> str:
    lines = rf"list_transform(string_split(regexp_replace({c}, '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '[ \t]+$', ''))"
    kept = rf"list_filter({lines}, lambda x: NOT regexp_matches(x, '^\s*(?:-{{{{3,}}}}|\*{{{{3,}}}}|_{{{{3,}}}})\s*$'))".replace("{{", "{").replace("}}", "}")
    return _strip(rf"regexp_replace(array_to_string({kept}, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')")


def _collapse(c: str) -> str:
    return _strip(rf"regexp_replace({c}, '\s+', ' ', 'g')")


def _cut(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE left({c}, {n - 1}) || '…' END"


_FIRST = "split_part(text, chr(10), 1)"
_DERIVED = f"""d AS (
  SELECT id, text, {_strip(f"regexp_replace(regexp_extract({_FIRST}, '^[^。！？!?；;]*'), {_text(P.re2(V.LEADING_MARK))}, '')")} AS a, {_strip(f"regexp_replace(text, {_text(P.re2(V.LEADING_MARK))}, '')")} AS b FROM mem),
t AS (SELECT id, text, CASE WHEN a = '' THEN b ELSE a END AS t FROM d),
h AS (SELECT *, left(t, {V.TITLE_MAX_CHARS}) AS head FROM t),
k AS (SELECT *, CASE WHEN regexp_matches(head, '(?s)[ ，]') THEN length(regexp_extract(head, '(?s)^(.*)[ ，]', 1)) ELSE -1 END AS last FROM h)"""

_SIM = f"""p AS {_values(views.PAIRS, 'pair_id, a, b')},
g AS (SELECT pair_id, {_grams(_norm('a'))} AS ga, {_grams(_norm('b'))} AS gb FROM p),
s AS (SELECT pair_id, ga, gb, len(list_intersect(ga, gb)) AS c FROM g)"""
_MARK_A, _REST_A = _statement("a")
_MARK_B, _REST_B = _statement("b")
_MARK_T, _REST_T = _statement("text")
_TITLE = f"CASE WHEN length(title) <= {V.TITLE_MAX_CHARS} THEN title END"
_LABEL = _case_of(V.SCOPE_LABEL, "scope")
_INDEX_LINE = f"'- ' || CASE WHEN pinned THEN '★' ELSE '' END || '[' || {_LABEL} || '] ' || title || ' #' || array_to_string(tags[1:3], ' #') || ' · #' || id"

_GATED = f"""{_extracted()},
jd AS (SELECT *, {_reason('text', 'vouched', 'true')} AS reason FROM ex),
sd AS (SELECT *, {_scope('kind', 'text')} AS decided FROM jd WHERE reason IS NULL)"""
_FROM_STATEMENTS = """
cands AS (SELECT msg_id * 100 + pos AS cand_id, kind, text, CASE decided WHEN 'identity' THEN 'global' ELSE decided END AS scope, CASE WHEN decided = 'project' THEN 'src1' END AS project_key FROM sd)"""


def _chatgpt() -> str:
    from .queries import _CHATGPT

    return f"""WITH x AS (SELECT {_text(_CHATGPT)}::JSON AS j), c AS (SELECT unnest(json_extract(j, '$[*]')) AS c, generate_subscripts(json_extract(j, '$[*]'), 1) - 1 AS n FROM x),
n AS (SELECT n, c, unnest(json_keys(c, '$.mapping')) AS k, generate_subscripts(json_keys(c, '$.mapping'), 1) AS node FROM c WHERE json_type(c) = 'OBJECT'),
m AS (SELECT n, node, c->>'$.conversation_id' AS conv, c->>'$.title' AS title, (c->>'$.create_time')::DOUBLE AS cs, json_extract(c, '$.mapping.' || k || '.message') AS m FROM n),
t AS (
  SELECT n, node, conv, title, m->>'$.author.role' AS role, coalesce((m->>'$.create_time')::DOUBLE, cs) AS s, m->>'$.id' AS mid,
         trim(array_to_string(list_filter(list_transform(json_extract(m, '$.content.parts[*]'), lambda p: CASE WHEN json_type(p) = 'VARCHAR' THEN json_extract_string(p, '$') END), lambda q: q IS NOT NULL AND trim(q) <> ''), chr(10))) AS text
  FROM m WHERE json_type(m) = 'OBJECT'),
o AS (SELECT *, n * 1048576 + row_number() OVER (PARTITION BY n ORDER BY s, node) - 1 AS ord FROM t WHERE text <> '' AND role IN ('user', 'assistant'))
SELECT ord, text, 'conversations.json#' || title AS uri, left(sha256('chatgpt|' || conv || '|' || coalesce(nullif(mid, ''), left(sha256(text), 16))), 24) AS item_id,
       strftime(make_timestamp((s * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS at FROM o WHERE role = 'user'"""


def _claude() -> str:
    from .queries import _CLAUDE

    return f"""WITH x AS (SELECT json_extract({_text(_CLAUDE)}::JSON, '$.conversations[*]') AS j), c AS (SELECT unnest(j) AS c, generate_subscripts(j, 1) - 1 AS n FROM x),
m AS (SELECT n, c, unnest(json_extract(c, '$.chat_messages[*]')) AS m, generate_subscripts(json_extract(c, '$.chat_messages[*]'), 1) - 1 AS node FROM c),
t AS (
  SELECT n, node, c->>'$.uuid' AS conv, c->>'$.name' AS name, m->>'$.sender' AS sender, m->>'$.uuid' AS mid, coalesce(m->>'$.created_at', c->>'$.created_at') AS seen,
         coalesce(nullif(trim(coalesce(m->>'$.text', '')), ''), trim(array_to_string(json_extract_string(m, '$.content[*].text'), chr(10)))) AS said, array_to_string(json_extract_string(m, '$.attachments[*].extracted_content'), chr(10) || chr(10)) AS blob FROM m)
SELECT n * 1048576 + node AS ord, said || CASE WHEN blob <> '' THEN chr(10) || chr(10) || {_text(V.ATTACHMENT_MARKER)} || chr(10) || blob ELSE '' END AS text, 'conversations.json#' || name AS uri,
       left(sha256('claude-web|' || conv || '|' || mid), 24) AS item_id, strftime(replace(seen, 'Z', '')::TIMESTAMP, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS at FROM t WHERE sender = 'human'"""


def _merged(a: str, b: str) -> str:
    a, b = _strip(a), _strip(b)
    return f"CASE WHEN {a} = '' OR {a} = {b} OR contains({b}, {a}) THEN {b} WHEN contains({a}, {b}) THEN {a} ELSE {a} || chr(10) || {b} END"


def _label(title: str, body: str) -> str:
    lines = rf"list_filter(list_transform(string_split({body}, chr(10)), lambda x: {_strip("regexp_replace(x, '^[-*>#\\s]+', '')")}), lambda x: x <> '')"
    first = _strip(f"regexp_extract(coalesce({lines}[1], ''), '^[^。.!?！？]*')")
    merged = f"left({title}, {V.LABEL_TITLE_CHARS}) || CASE WHEN {first} = '' THEN '' ELSE ' · ' || {first} END"
    return f"CASE WHEN length({merged}) <= {V.LABEL_CHARS} THEN {merged} ELSE left({merged}, {V.LABEL_CHARS}) || '…' END"


def _budget() -> str:
    """The fold of 50 groups, a section a step."""
    marker = V.TRUNCATION_MARKER
    head = f"left(t, (room - {len(marker)})::INT)"
    last = f"CASE WHEN contains({head}, chr(10)) THEN length(regexp_extract({head}, '(?s)^(.*)\\n', 1)) ELSE -1 END"
    cut = rf"CASE WHEN room <= {len(marker)} THEN left({_text(marker)}, greatest(room, 0)::INT) ELSE regexp_replace(CASE WHEN {last} > (room - {len(marker)}) / 2 THEN left({head}, {last}) ELSE {head} END, '\s+$', '') || {_text(marker)} END"
    return f"""WITH RECURSIVE {_MEM},
s AS (SELECT id % 50 AS g, row_number() OVER (PARTITION BY id % 50 ORDER BY id) AS n, title, {_strip('text')} AS t, pinned FROM mem WHERE status = 'active'),
f AS (
  SELECT DISTINCT g, 0::BIGINT AS n, {V.TURN_BUDGET}::BIGINT AS remaining, 0::BIGINT AS kept, 0::BIGINT AS used, ''::VARCHAR AS summary FROM s
  UNION ALL
  SELECT g, n, CASE WHEN fits OR partly THEN room - size ELSE remaining END, kept + (fits OR partly)::INT, used + CASE WHEN fits OR partly THEN size + gap ELSE 0 END,
         summary || CASE WHEN t = '' THEN '' ELSE CASE WHEN summary = '' THEN '' ELSE ', ' END || title || CASE WHEN fits THEN ': ' || size || ' chars' WHEN partly THEN ': ' || size || ' chars (truncated)' ELSE ': dropped' END END
  FROM (SELECT *, CASE WHEN fits THEN length(t) ELSE length(cut) END AS size, NOT fits AND t <> '' AND pinned AND room > 0 AND cut <> '' AND contains(cut, chr(10)) AS partly
        FROM (SELECT *, t <> '' AND length(t) <= room AS fits, {cut} AS cut
              FROM (SELECT f.g, s.n, f.remaining, f.kept, f.used, f.summary, s.title, s.t, s.pinned, CASE WHEN f.kept > 0 THEN 2 ELSE 0 END AS gap, f.remaining - CASE WHEN f.kept > 0 THEN 2 ELSE 0 END AS room
                    FROM f JOIN s ON s.g = f.g AND s.n = f.n + 1))))
SELECT g, arg_max(used, n)::INT AS used, CASE WHEN arg_max(summary, n) = '' THEN 'nothing injected' ELSE arg_max(summary, n) END AS summary FROM f GROUP BY g"""


def _export() -> str:
    nl = "chr(10)"
    meta = f"concat_ws(' · ', '状态 ' || status, '重要度 ' || importance, CASE WHEN pinned THEN '已固定' END, '项目 ' || project_key, '标签 ' || array_to_string(tags, ', '), '来源 ' || source, '更新 ' || strftime(created_at, '%Y-%m-%d %H:%M:%S.%g'))"
    entry = f"'### ' || title || {nl} || {nl} || '- ' || {meta} || {nl} || {nl} || {_strip('text')} || {nl} || {nl} || '---' || {nl}"
    named = " UNION ALL ".join(f"SELECT {i} AS sec, {_text(scope)} AS scope, {_text(V.SCOPE_TITLES[scope])} AS shown" for i, scope in enumerate(V.SCOPES))
    return f"""WITH {_MEM}, sec AS ({named}),
r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY CASE WHEN scope = 'daily' THEN 0 ELSE importance END DESC, created_at DESC, id DESC) AS n FROM mem WHERE status IN ('active', 'pending') OR scope = 'identity'),
k AS (SELECT *, CASE WHEN scope = 'project' THEN min(n) OVER (PARTITION BY scope, project_key) ELSE 0 END AS grp FROM r JOIN sec USING (scope) WHERE n <= {V.EXPORT_LIMIT}),
b AS (
  SELECT sec, -1 AS grp, 0 AS n, '## ' || any_value(shown) || {nl} AS block FROM k GROUP BY sec
  UNION ALL SELECT sec, grp, 0, '### 项目 ' || coalesce(project_key, {_text(V.UNNAMED_PROJECT)}) || {nl} FROM k WHERE scope = 'project' AND n = grp
  UNION ALL SELECT sec, grp, n, {entry} FROM k),
d AS (SELECT '# 记忆导出' || {nl} || {nl} || '- 导出时间：2024-02-01 00:00' || {nl} || '- 条目：' || (SELECT count(*) FROM k) || {nl} || '- 层级：{' / '.join(V.SCOPES)}' || {nl} || '- 状态：active / pending' || {nl} || {nl}
      || string_agg(block, {nl} ORDER BY sec, grp, n) AS t FROM b),
o AS (SELECT regexp_replace(t, '\\s+$', '') || {nl} AS t FROM d)
SELECT length(t)::INT AS chars, sha256(t) AS digest FROM o"""


_SAID = ", ".join(_text(message) for _, message in views.STATEMENTS)
_TURNS = f"(SELECT conv_id * 1000 + turn AS msg_id, text || chr(10) || [{_SAID}][(conv_id + turn) % {len(views.STATEMENTS)} + 1] AS message FROM conversations WHERE text IS NOT NULL)"
_TAGGED = f"list_filter(list_transform(string_split(text, ' ')[1:30], lambda x: left({_strip('x')}, {V.TAG_CHARS})), lambda x: x <> '')"


ORACLE_SQL: dict[str, str] = {
    "merge_apply_snapshot": f"""WITH {_merge_plan()},
        inn AS (SELECT target AS id, list(text ORDER BY cand_id) AS parts FROM plan JOIN cands USING (cand_id) WHERE decision = 'merge' GROUP BY 1),
        kept AS (SELECT scope, CASE WHEN id IN (SELECT target FROM plan WHERE decision = 'update') THEN 'outdated' ELSE status END AS status,
                        CASE WHEN parts IS NULL THEN text ELSE list_reduce(parts, lambda a, b: {_merged('a', 'b')}, text) END AS text FROM mem LEFT JOIN inn USING (id)),
        al AS (SELECT * FROM kept UNION ALL SELECT scope, 'active', {_strip('text')} FROM cands JOIN plan USING (cand_id) WHERE decision IN ('new', 'update'))
        SELECT scope, status, count(*) AS n, sum(length(text))::BIGINT AS chars FROM al GROUP BY 1, 2""",
    "budget_fold": _budget(),
    "export_document": _export(),
    "daily_document": f"""WITH {_MEM}, d AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS r FROM mem WHERE scope = 'daily' AND status IN ('active', 'pending', 'archived') AND project_key = 'src6'),
        o AS (SELECT regexp_replace('# Daily log' || chr(10) || chr(10) || coalesce(string_agg('## ' || strftime(created_at, '%Y-%m-%d') || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY r), ''), '\\s+$', '') || chr(10) AS t FROM d WHERE r <= {V.DAILY_LIMIT})
        SELECT length(t)::INT AS chars, sha256(t) AS digest FROM o""",
    "mem_any_project": f"WITH {_MEM} SELECT id, project_key FROM mem WHERE project_key IS NOT NULL AND status = 'active'",
    "panel_rows": f"""WITH {_MEM} SELECT 'layer' AS ask, id, scope FROM mem WHERE scope = 'global' AND status = 'active' AND list_contains(tags, 'fr') AND project_key IS NULL
        UNION ALL SELECT 'project', id, scope FROM mem WHERE list_contains(tags, 'en') AND project_key = 'src2'""",
    "mem_listed_scopes": f"""WITH {_MEM} SELECT 'keyless' AS ask, id, scope FROM mem WHERE scope = 'global' OR scope = 'daily' AND project_key IS NULL
        UNION ALL SELECT 'keyed', id, scope FROM mem WHERE scope = 'global' OR scope = 'project' AND project_key = 'src4'""",
    "panel_clamps": f"""SELECT doc_id AS id, CASE WHEN doc_id % 5 > 0 THEN greatest(1, least(200, doc_id * 37 % 400 - 50)) ELSE 30 END::INT AS "limit", greatest(0, least(1000000, (doc_id - 20) * 9973))::INT AS "offset",
        CASE WHEN doc_id % 4 > 0 THEN greatest(0, least(5, doc_id % 11 - 3)) END::INT AS importance, CASE WHEN doc_id % 3 > 0 THEN greatest(1, least(200, doc_id % 300 - 10)) ELSE 200 END::INT AS entries,
        least(32, len(string_split(text, ' ')))::INT AS n_tags, array_to_string(list_transform(string_split(text, ' ')[1:32], lambda x: left(x, 40)), '|') AS tags, left(text, 200) AS title, doc_id % 5 <> {len(V.SCOPES)} AS valid FROM documents""",
    "attachments_cut": f"WITH {_MEM} SELECT id, sha256(text) AS digest FROM mem",
    "project_keys": f"WITH {_MEM} SELECT id, left(sha1('git' || chr(0) || lower(project_path || '/Repo' || id)), 16) AS key FROM mem",
    "joined_sections": f"WITH {_MEM} SELECT id, sha256({_strip('title')} || chr(10) || chr(10) || CASE WHEN id % 2 = 0 AND {_strip('text')} <> '' THEN {_strip('text')} || chr(10) || chr(10) ELSE '' END || 'end') AS digest FROM mem",
    "tag_lists": f"WITH {_MEM}, t AS (SELECT id, {_TAGGED} AS l FROM mem) SELECT id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:{V.TAG_CAP}], '|') AS tags FROM t",
    "like_escapes": f"""WITH {_MEM}, h AS (SELECT id, left(text, 60) || '100%_!' AS head FROM mem)
        SELECT id, replace(replace(replace(head, '!', '!!'), '%', '!%'), '_', '!_') AS pattern, true AS own, substr(head, 2) || 'x' = head AS other FROM h""",
    "natural_order": f"WITH {_MEM} SELECT id, project_path, row_number() OVER (PARTITION BY project_path ORDER BY id)::INT AS pos FROM mem",
    "day_keys": f"WITH {_MEM} SELECT id, strftime(created_at + INTERVAL 8 HOUR, '%Y-%m-%d') AS day FROM mem",
    "neighbour_pairs": f"""WITH {_MEM}, t AS MATERIALIZED (SELECT id, {_norm('text')} AS n, {_MARK_T} IS NOT NULL AS neg, {_REST_T} AS aff FROM mem),
        g AS MATERIALIZED (SELECT id, neg, aff, {_grams('n')} AS g, {_norm('aff')} AS an FROM t), h AS MATERIALIZED (SELECT id, neg, aff, g, {_grams('an')} AS ag FROM g),
        p AS MATERIALIZED (SELECT l.id, l.g AS ga, r.g AS gb, len(list_intersect(l.g, r.g)) AS c, l.neg <> r.neg AS differ, length(l.aff) <= length(r.aff) AS first, l.aff AS x, r.aff AS y, l.ag AS gx, r.ag AS gy, len(list_intersect(l.ag, r.ag)) AS ac FROM h l JOIN h r ON r.id = l.id + 1)
        SELECT id, round(CASE WHEN len(ga) + len(gb) = 0 THEN 1 ELSE c / (len(ga) + len(gb) - c) END, 6) AS sim, round(CASE WHEN len(ga) = 0 THEN 0 ELSE c / len(ga) END, 6) AS share,
               differ AND CASE WHEN first THEN length(x) > 0 AND (contains(y, x) OR len(gx) > 0 AND ac / len(gx) >= {V.CONTRADICTION_OVERLAP}) ELSE length(y) > 0 AND (contains(x, y) OR len(gy) > 0 AND ac / len(gy) >= {V.CONTRADICTION_OVERLAP}) END AS clash FROM p""",
    "extract_turns": f"WITH {_extracted(_TURNS)} SELECT * FROM ex",
    "extract_batches": f"""WITH {_extracted(_TURNS, V.BATCH_CANDIDATES)}, f AS (SELECT *, msg_id // 1000 AS conv_id, row_number() OVER (PARTITION BY msg_id // 1000, lower(text) ORDER BY msg_id, pos) AS n FROM ex),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY msg_id, pos) AS i FROM f WHERE n = 1)
        SELECT conv_id, msg_id % 1000 AS turn, pos, text, kind FROM o WHERE i <= {V.BATCH_CANDIDATES}""",
    "step_queries": f"""SELECT conv_id AS session, right(arg_max({_strip('text')}, turn), {V.STEP_QUERY_CHARS}) AS query FROM conversations WHERE role = 'user' AND {_strip('text')} <> '' GROUP BY 1""",
    "memory_file_items": f"""WITH {_MEM}, b AS (SELECT id, title, {_strip('text')} AS body, 'key-' || id AS key FROM mem)
        SELECT 'm' || id || '#conversations_memory/1' AS uri, 'claude-memory|conversations|Topic ' || id AS item_id, {_label("('Topic ' || id)", 'title')} AS title, 'claude,memory' AS tags, sha256(title) AS digest FROM b
        UNION ALL SELECT 'm' || id || '#project/' || left(key, 8), 'claude-memory|project|' || key, {_label("('Claude project memory · ' || left(key, 8))", 'body')}, 'claude,memory,project:' || left(key, 8), sha256(body) FROM b WHERE body <> ''
        UNION ALL SELECT 'm' || id || '#file/notes/' || id || '.md', 'claude-memory|file|notes/' || id || '.md', {_label("('Claude memory file · ' || id || '.md')", 'body')}, 'claude,memory,memory-file', sha256(body) FROM b WHERE body <> ''""",
    "json_wrapped": f"""WITH {_MEM}, b AS (SELECT *, {_body('text')} AS body FROM mem)
        SELECT 'x' || id || '.json' AS uri, 'file|' || id AS item_id, title, CASE WHEN id % 4 <> 1 THEN scope END AS scope, strftime(created_at, '%Y-%m-%d') AS at, sha256(body) AS digest FROM b WHERE body <> ''""",
    "merge_widened": f"WITH {_merge_plan(kind="'correction'")} SELECT cand_id, decision, target, reason FROM plan",
    "distill_report": f"""WITH {_GATED},{_merge_plan(_FROM_STATEMENTS, 'kind')}
        SELECT count(*) FILTER (WHERE decision = 'new') AS written, count(*) FILTER (WHERE decision = 'merge') AS merged, count(*) FILTER (WHERE decision = 'update') AS updated,
               count(*) FILTER (WHERE decision = 'ignore') AS ignored, (SELECT count(*) FROM jd WHERE reason IS NOT NULL) AS rejected FROM plan""",
    "chatgpt_flatten": _chatgpt(),
    "claude_web_flatten": _claude(),
    **{
        f"mem_list_{name}": f"WITH {_MEM}, r AS (SELECT id, title, importance, row_number() OVER (ORDER BY {o}) AS n FROM mem WHERE scope IN ('global', 'project') AND status = 'active') "
        "SELECT (n - 10)::INT AS pos, id, title, importance FROM r WHERE n > 10 AND n <= 60"
        for name, o in _ORDERS.items()
    },
    "mem_filter_scope_status_tag": f"WITH {_MEM} SELECT id, title, status FROM mem WHERE scope = 'global' AND status IN ('active', 'pending') AND pinned AND list_contains(tags, 'fr')",
    "mem_visible_for_key": f"""WITH {_MEM}, r AS (
        SELECT CASE WHEN scope = 'global' THEN 0 ELSE 1 END AS side, id, row_number() OVER (PARTITION BY scope = 'global' ORDER BY created_at DESC, id DESC)::INT AS ord FROM mem
        WHERE status = 'active' AND (scope = 'global' AND project_key IS NULL OR scope IN ('project', 'daily') AND project_key = 'src3')) SELECT side, ord, id FROM r WHERE ord <= 600""",
    "mem_visible_null_key": f"""WITH {_MEM}, r AS (
        SELECT CASE WHEN scope = 'global' THEN 0 ELSE 1 END AS side, id, row_number() OVER (PARTITION BY scope = 'global' ORDER BY coalesce(last_used_at, created_at) DESC, id DESC)::INT AS ord FROM mem
        WHERE scope = 'global' AND project_key IS NULL OR scope = 'daily' AND project_key IS NULL) SELECT side, ord, id FROM r WHERE ord <= 100""",
    "mem_count": f"WITH {_MEM} SELECT count(*) AS n FROM mem WHERE project_key = 'src5' AND status = 'active'",
    "mem_projects": f"WITH {_MEM} SELECT project_key, max(project_path) AS project_path, count(*) AS n FROM mem WHERE project_key IS NOT NULL GROUP BY 1",
    "mem_tags": f"WITH {_MEM}, t AS (SELECT unnest(tags) AS tag FROM mem) SELECT tag, count(*) AS n FROM t GROUP BY 1",
    "mem_attach_tags": f"WITH {_MEM} SELECT id, source || ',' || tags[1] AS tags FROM mem",
    "mem_overview": f"""WITH {_MEM}, c AS (
        SELECT 'scope' AS kind, scope AS name FROM mem UNION ALL SELECT 'status', status FROM mem UNION ALL SELECT 'source', source FROM mem UNION ALL SELECT 'total', 'all' FROM mem),
        z AS (SELECT 'scope' AS kind, unnest(['identity', 'global', 'project', 'daily']) AS name UNION ALL SELECT 'status', unnest(['active', 'outdated', 'archived', 'pending']) UNION ALL SELECT 'total', 'all'),
        n AS (SELECT kind, name, count(*) AS n FROM c GROUP BY 1, 2)
        SELECT coalesce(n.kind, z.kind) AS kind, coalesce(n.name, z.name) AS name, coalesce(n, 0)::BIGINT AS n FROM n FULL JOIN z ON n.kind = z.kind AND n.name = z.name""",
    "mem_eviction": f"""WITH {_MEM}, r AS (SELECT id, importance, row_number() OVER (ORDER BY coalesce(last_used_at, created_at) DESC, created_at DESC, importance DESC, id) AS n FROM mem WHERE NOT pinned AND status = 'active')
        SELECT id, importance FROM r WHERE n > 100""",
    "mem_get_many": f"WITH {_MEM} SELECT pos::INT AS pos, id, title FROM mem JOIN (VALUES (0, 7), (1, 3), (2, 999999999), (3, 11), (4, 42)) w(pos, id) USING (id)",
    "mem_forget": f"""WITH {_MEM}, w AS (SELECT (range * 17)::BIGINT AS id FROM range(60)) SELECT w.id, CASE WHEN status IS NULL THEN 'unknown' WHEN scope = 'identity' THEN 'identity'
        WHEN scope IN ('project', 'daily') AND project_key IS NOT NULL AND project_key <> 'src3' THEN 'other-project' WHEN status = 'archived' THEN 'already-archived' ELSE 'archived' END AS outcome FROM w LEFT JOIN mem USING (id)""",
    "mem_update": f"""WITH {_MEM} SELECT id, CASE WHEN id % 10 = 3 THEN 'archived' ELSE status END AS status, CASE WHEN id % 20 = 3 THEN 9 ELSE importance END AS importance,
        (id % 10 = 3 AND status <> 'archived') OR (id % 20 = 3 AND importance <> 9) AS moved FROM mem""",
    "mem_touch": f"WITH {_MEM} SELECT id, CASE WHEN id % 13 = 0 THEN '2024-02-01 00:00' ELSE strftime(last_used_at, '%Y-%m-%d %H:%M') END AS used FROM mem",
    "mem_insert": f"WITH {_MEM},{_CANDS} SELECT (SELECT max(id) FROM mem) + row_number() OVER (ORDER BY cand_id) AS id, {_strip('text')} AS text, scope, 'active' AS status FROM cands",
    "mem_remove": f"""WITH {_MEM} SELECT 'memories' AS what, count(*) FILTER (WHERE id % 3 <> 0) AS n FROM mem UNION ALL SELECT 'tags', 2 * count(*) FILTER (WHERE id % 3 <> 0) FROM mem
        UNION ALL SELECT 'freed', count(*) FILTER (WHERE id % 3 = 0) FROM mem""",
    "panel_view": f"WITH {_MEM} SELECT id, left(text, 600) AS text, length(text) > 600 AS text_truncated FROM mem",
    "norm_compare": f"WITH {_MEM}, n AS (SELECT id, {_norm('text')} AS norm FROM mem) SELECT id, length(norm)::INT AS n, sha256(norm) AS digest FROM n",
    "bigram_profile": f"WITH {_MEM}, n AS (SELECT id, {_norm('text')} AS norm FROM mem), g AS (SELECT unnest({_grams('norm')}) AS gram FROM n) SELECT gram, count(*) AS df FROM g GROUP BY 1",
    "jaccard_pairs": f"WITH {_SIM} SELECT pair_id, round(CASE WHEN len(ga) + len(gb) = 0 THEN 1 ELSE c / (len(ga) + len(gb) - c) END, 6) AS sim FROM s",
    "containment_pairs": f"WITH {_SIM} SELECT pair_id, round(CASE WHEN len(ga) = 0 THEN 0 ELSE c / len(ga) END, 6) AS share FROM s",
    "statement_polarity": f"WITH {_MEM} SELECT id, {_MARK_T} IS NOT NULL AS negative, {_MARK_T} AS marker, length({_REST_T})::INT AS n FROM mem",
    "contradict_pairs": f"""WITH p AS {_values(views.PAIRS, 'pair_id, a, b')}, s AS (SELECT pair_id, {_MARK_A} IS NOT NULL AS na, {_MARK_B} IS NOT NULL AS nb, {_REST_A} AS x, {_REST_B} AS y FROM p),
        o AS (SELECT pair_id, na, nb, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS s, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS l FROM s),
        g AS (SELECT *, {_grams(_norm('s'))} AS gs, {_grams(_norm('l'))} AS gl FROM o)
        SELECT pair_id, na <> nb AND length(s) > 0 AND (contains(l, s) OR CASE WHEN len(gs) = 0 THEN 0 ELSE len(list_intersect(gs, gl)) / len(gs) END >= 0.6) AS clash FROM g""",
    "content_terms": rf"""WITH {_MEM}, w AS (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) AS term FROM mem)
        SELECT term, count(*) AS n FROM w WHERE term <> '' AND term NOT IN ({', '.join(map(_text, V.NEGATIONS))}) GROUP BY 1""",
    "merge_similar": f"""WITH {_MEM},{_CANDS}, la AS (SELECT id, scope, CASE WHEN scope = 'project' THEN coalesce(project_key, '-') ELSE '*' END AS k, {_norm('text')} AS nrm FROM mem WHERE status = 'active'),
        ca AS (SELECT cand_id, scope, CASE WHEN scope = 'project' THEN coalesce(project_key, '-') ELSE '*' END AS k, {_norm('text')} AS nrm FROM cands),
        pr AS (SELECT cand_id, id, {_grams('ca.nrm')} AS ga, {_grams('la.nrm')} AS gb FROM ca JOIN la USING (scope, k)),
        sc AS (SELECT cand_id, id, len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb))) AS score FROM pr)
        SELECT cand_id, id, round(score, 6) AS score FROM sc WHERE score >= {V.MERGE_SIMILARITY}""",
    "merge_plan_snapshot": f"WITH {_merge_plan()} SELECT cand_id, decision, target, reason FROM plan",
    "fts_and": f"WITH {_MEM},{_fts(((1, 'tion the ing'),), _text('src1'), 40)} SELECT id, round(rank, 6) AS rank, n_matched FROM fts",
    "fts_or_relax": f"WITH {_MEM},{_fts(((1, 'tionre qqqxz'),), _text('src1'), 40)} SELECT id, round(rank, 6) AS rank, n_matched FROM fts",
    "bm25_rank": f"WITH {_MEM},{_bm25(views.QUERIES)} SELECT query_id, id, round(rank, 6) AS rank, n_matched FROM bm",
    "like_short": f"WITH {_MEM}, parts AS (SELECT * FROM (VALUES (1, 'zu', 'like'), (1, 'en', 'like'), (2, 'ou', 'like')) x(query_id, fragment, kind)),{_like(_text('src2'), 40)} SELECT query_id, id, matched::INT AS matched FROM lk",
    "hybrid_search": f"WITH {_MEM},{_hybrid(views.QUERIES, _text('src1'), 10)} SELECT query_id, pos, id, round(score, 6) AS score, match FROM hy",
    "search_scope_postfilter": f"WITH {_MEM},{_hybrid(((0, 'tionre ethese ou'),), _text('src1'), 20)} SELECT id, round(score, 6) AS score FROM hy WHERE scope = 'global' ORDER BY pos LIMIT 10",
    "split_sentences": f"WITH st AS {_values(views.STATEMENTS, 'msg_id, message')}, c AS (SELECT msg_id, {_clauses('message')} AS cs FROM st) SELECT msg_id, (generate_subscripts(cs, 1) - 1)::INT AS pos, unnest(cs) AS clause FROM c",
    "split_sentences_corpus": f"WITH {_MEM}, c AS (SELECT id, {_clauses('text')} AS cs FROM mem) SELECT id, len(cs)::INT AS n, length(array_to_string(cs, ''))::INT AS chars FROM c",
    "extract_candidates": f"WITH {_extracted()} SELECT * FROM ex",
    "classify_corpus": f"WITH {_MEM}, k AS (SELECT {_classify('text')} AS kind FROM mem) SELECT kind, count(*) AS n FROM k GROUP BY 1",
    "judge_gate": f"""WITH {_extracted()}, j AS (SELECT *, {_reason('text', 'vouched', 'true')} AS reason FROM ex)
        SELECT msg_id, pos, kind, reason IS NULL AS accepted, reason, CASE WHEN reason IS NULL THEN {_importance('kind', 'text')} ELSE 0 END AS importance,
               CASE WHEN reason IS NULL THEN {_scope('kind', 'text')} ELSE {_case_of(V.BASE_SCOPE, 'kind')} END AS scope FROM j""",
    "judge_corpus": f"""WITH {_MEM}, k AS (SELECT text, {_classify('text')} AS kind FROM mem), j AS (SELECT text, kind, {_reason('text', 'false', 'true')} AS reason FROM k),
        s AS (SELECT kind, reason, CASE WHEN reason IS NULL THEN {_scope('kind', 'text')} ELSE {_case_of(V.BASE_SCOPE, 'kind')} END AS scope, CASE WHEN reason IS NULL THEN {_importance('kind', 'text')} ELSE 0 END AS importance FROM j)
        SELECT kind, reason, scope, importance, count(*) AS n FROM s GROUP BY 1, 2, 3, 4""",
    "paste_filter": f"WITH {_MEM}, st AS {_values(views.STATEMENTS, 'msg_id, message')} SELECT msg_id, {_paste('message')} AS paste FROM st UNION ALL SELECT id::INT, {_paste('text')} FROM mem",
    "strip_code": f"WITH st AS {_values(views.STATEMENTS, 'msg_id, message')} SELECT msg_id, regexp_replace({_unfenced('message')}, '`[^`' || chr(10) || ']*`', ' ', 'g') AS plain, {_unfenced('message')} AS unfenced FROM st",
    "normalise_bodies": f"WITH {_MEM}, h AS (SELECT id, text, regexp_replace({_collapse(_FIRST)}, '^[-*>#\\s]+', '') AS h FROM mem) SELECT id, sha256({_body('text')}) AS digest, {_cut('h', 80)} AS headline FROM h",
    "titles": f"""WITH {_MEM}, {_DERIVED} SELECT id, CASE WHEN length(t) <= {V.TITLE_MAX_CHARS} THEN t ELSE regexp_replace(CASE WHEN last > {V.TITLE_MAX_CHARS} / 2 THEN left(head, last) ELSE head END, '\\s+$', '') || '…' END AS title,
        {_cut(_collapse('text'), 60)} AS clip FROM k""",
    "markdown_sections": f"""WITH {_MEM}, b AS (SELECT id, title, {_body('text')} AS body FROM mem) SELECT 'note' || (id % 25) || '#' || title AS uri, title, length(body)::INT AS n, sha256(body) AS digest FROM b WHERE body <> ''""",
    "generic_json_lines": f"WITH {_MEM}, b AS (SELECT *, {_body('text')} AS body FROM mem) SELECT 'file|' || id AS item_id, title, scope, array_to_string(tags, ',') AS tags, sha256(body) AS digest FROM b WHERE body <> ''",
    "recency_scores": f"WITH {_MEM} SELECT id, round(pow(2, -greatest((epoch_us({_NOW}) - epoch_us(coalesce(last_used_at, created_at))) / 86400e6, 0) / 14), 6) AS recency FROM mem",
    "item_hash": f"WITH {_UTT} SELECT ord, {_HASH.format(platform=_text('chatgpt'), identity='coalesce(CASE WHEN ord % 2 = 0 THEN item_id END, ' + _COLLAPSED + ')')} AS hash FROM utt",
    "ledger_new": f"WITH {_LEDGER} SELECT ord, hash FROM lu WHERE hash NOT IN (SELECT hash FROM ledger WHERE memory_id IS NOT NULL)",
    "ledger_known": f"WITH {_LEDGER} SELECT ord, hash FROM lu WHERE hash IN (SELECT hash FROM ledger WHERE memory_id IS NOT NULL)",
    "ledger_record": f"""WITH {_LEDGER}, e AS (SELECT hash, arg_max(ord, ord) AS memory_id FROM lu WHERE ord % 5 = 0 GROUP BY 1)
        SELECT hash, memory_id FROM ledger WHERE hash NOT IN (SELECT hash FROM e) UNION ALL SELECT hash, memory_id FROM e""",
    "daily_append": """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, 'u' || user_id AS project_key, event_id, '- [' || event_type || '] value ' || round(value, 1)::VARCHAR AS line FROM events)
        SELECT day, project_key, sha256(string_agg(line, chr(10) || chr(10) ORDER BY event_id)) AS digest, count(*) AS n_entries FROM e GROUP BY 1, 2""",
    "daily_list": f"""WITH {_MEM}, d AS (SELECT id, text, strftime(created_at, '%Y-%m-%d') AS date, row_number() OVER (ORDER BY created_at DESC, id DESC) AS r FROM mem
        WHERE scope = 'daily' AND status IN ('active', 'pending', 'archived') AND project_key = 'src6')
        SELECT id, date, len(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {_strip('x')}), lambda x: x <> ''))::INT AS n FROM d WHERE r <= 30""",
    "daily_purge": f"WITH {_MEM} SELECT id, strftime(created_at, '%Y-%m-%d') AS date FROM mem WHERE scope = 'daily' AND status = 'active' AND strftime(created_at, '%Y-%m-%d') < strftime({_NOW} - INTERVAL 30 DAY, '%Y-%m-%d')",
    "render_index": f"""WITH {_MEM} SELECT project_key, '[记忆索引 · ' || count(*) || ' 条]' || chr(10) || string_agg({_INDEX_LINE}, chr(10) ORDER BY id) AS text, count(*) AS n
        FROM mem WHERE status = 'active' AND project_key IS NOT NULL GROUP BY 1""",
    "render_cards": f"""WITH {_MEM} SELECT project_key, count(*) AS n, sha256('[相关记忆 · ' || count(*) || ' 条 · 按相关度]' || chr(10) || chr(10) || string_agg('### [' || {_LABEL} || '] ' || title || ' (' || array_to_string(tags[1:4], ', ') || ') — #' || id || chr(10) || {_strip('text')}, chr(10) || chr(10) ORDER BY id)) AS digest
        FROM mem WHERE status = 'active' AND pinned AND project_key IS NOT NULL GROUP BY 1""",
    "fit_index": f"""WITH {_MEM}, l AS (SELECT project_key, id, {_INDEX_LINE} AS line FROM mem WHERE status = 'active' AND project_key IS NOT NULL),
        u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY project_key ORDER BY id) + length('[记忆索引 · ' || count(*) OVER (PARTITION BY project_key) || ' 条]') AS used FROM l)
        SELECT project_key, '[记忆索引 · ' || count(*) || ' 条]' || chr(10) || string_agg(line, chr(10) ORDER BY id) AS text, count(*) AS n FROM u WHERE used <= 900 GROUP BY 1""",
    "delivered_cards": f"""WITH {_MEM}, s AS (SELECT coalesce(project_key, '-') AS session, id FROM mem), g AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY id) AS r FROM s WHERE id % 3 = 0)
        SELECT session, count(*) AS n FROM s WHERE (session, id) NOT IN (SELECT (session, id) FROM g WHERE r <= 20) GROUP BY 1""",
    "jsonl_turns": f"""SELECT 'p/' || conv_id || '.jsonl#s' || conv_id AS uri, {_strip('text')} AS text,
        left(sha256('claude-code|s' || conv_id || '|' || n || '|user|' || {_strip('text')}), 24) AS item_id, 'claude,claude-code,/work/x' AS tags
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations) WHERE role = 'user' AND {_strip('text')} <> ''""",
}
ORACLE_SQL["distill_summary"] = f"SELECT written || ' written, ' || merged || ' merged, ' || updated || ' updated, ' || ignored || ' ignored, ' || rejected || ' rejected' AS summary FROM ({ORACLE_SQL['distill_report']})"
