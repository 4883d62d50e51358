"""DuckDB SQL for the operators that SQL can express."""

from minutespark.llm.chat_format import BUDGET, HISTORY_TOKENS, HISTORY_TURNS

_ESCAPED = r"regexp_replace(regexp_replace(replace({}, '\', '\\'), '(<)(\||/?s>)', '\1\\\2', 'g'), '(\[)(/?INST\])', '\1\\\2', 'g')"

OP1 = rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, len(regexp_extract_all(text, '\p{{L}}{{1,4}}|\p{{N}}{{1,3}}|[^\s\p{{L}}\p{{N}}]'))::BIGINT AS n,
  8 + length({_ESCAPED.format('role')}) + 1 + length({_ESCAPED.format('text')}) + 7 AS size FROM c),
t AS (SELECT *, row_number() OVER w AS pos, sum(n) OVER w AS total FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
l AS (SELECT conv_id, CASE WHEN role = 'system' THEN 1 ELSE 0 END AS lead, greatest({BUDGET - HISTORY_TOKENS} - CASE WHEN role = 'system' THEN n ELSE 0 END, 1) AS room, size AS lead_size, max_at
  FROM t JOIN (SELECT conv_id, max(pos) AS max_at FROM t GROUP BY 1) USING (conv_id) WHERE pos = 1),
r AS (
  SELECT t.conv_id, t.pos, t.pos AS first_at, t.total - t.n AS base FROM t JOIN l USING (conv_id) WHERE t.pos = CASE WHEN l.max_at > l.lead THEN l.lead + 1 ELSE 1 END
  UNION ALL
  SELECT t.conv_id, t.pos, CASE WHEN t.total - r.base > l.room THEN t.pos ELSE r.first_at END, CASE WHEN t.total - r.base > l.room THEN t.total - t.n ELSE r.base END
  FROM r JOIN t ON t.conv_id = r.conv_id AND t.pos = r.pos + 1 JOIN l ON l.conv_id = r.conv_id),
w AS (SELECT conv_id, first_at, count(*) AS n_new, sum(t.size) AS size FROM r JOIN t USING (conv_id, pos) GROUP BY 1, 2),
h AS (SELECT w.conv_id, w.first_at, sum(t.size) AS size FROM w JOIN l ON l.conv_id = w.conv_id JOIN t ON t.conv_id = w.conv_id AND t.pos < w.first_at AND t.pos > l.lead AND t.pos >= w.first_at - {HISTORY_TURNS}
  JOIN t p ON p.conv_id = w.conv_id AND p.pos = w.first_at - 1 WHERE p.total - t.total + t.n <= {HISTORY_TOKENS} GROUP BY 1, 2),
f AS (SELECT conv_id, count(*) AS n_windows, sum(w.size + coalesce(h.size, 0) + CASE WHEN lead = 1 AND first_at > 1 THEN lead_size ELSE 0 END)::BIGINT AS formatted_chars FROM w LEFT JOIN h USING (conv_id, first_at) JOIN l USING (conv_id) GROUP BY 1)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  any_value(formatted_chars) AS formatted_chars, any_value(n_windows) AS n_windows
FROM c JOIN f USING (conv_id) GROUP BY 1"""

OP5 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b USING (shingle) GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
c AS (SELECT a AS doc_id, b AS reached FROM e UNION SELECT c.doc_id, e.b FROM c JOIN e ON e.a = c.reached)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(reached) AS component FROM c GROUP BY 1) USING (doc_id)"""

ORACLES = {"op1_chat_format": OP1, "op5_jaccard_join": OP5}

ORACLES["op11_prefix_trie"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM c),
u AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, x:
  list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda b, k: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END, xor(a, x)), 4294967295::BIGINT), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM c)),
l AS (SELECT conv_id AS base, count(*) AS n FROM o GROUP BY 1),
s AS (SELECT u.conv_id, o.i AS d, role, text FROM u JOIN o ON o.conv_id = u.base AND o.i <= h
  UNION ALL SELECT o.conv_id, least(h, coalesce(l.n, 0)) + o.i - h, role, text FROM o JOIN u USING (conv_id) LEFT JOIN l USING (base) WHERE o.i > h),
p AS (SELECT conv_id, d, length(text) AS n, md5(array_to_string(list(md5(role || chr(0) || text)) OVER w, '')) AS name, md5(array_to_string((list(md5(role || chr(0) || text)) OVER w)[:-2], '')) AS parent FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY d)
  UNION ALL SELECT conv_id, 0, 0, md5(''), NULL FROM u),
v AS (SELECT name, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved FROM p GROUP BY 1),
k AS (SELECT v.*, (SELECT count(*) FROM v x WHERE x.parent = v.name) AS n_children FROM v),
t AS (SELECT p.name, count(*) FILTER (k.n_children = 0) AS n_leaves, sum(k.saved)::BIGINT AS saved_tokens FROM k JOIN p ON p.conv_id = k.conv_id AND p.d <= k.depth GROUP BY 1),
e AS (SELECT name, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM p JOIN (SELECT conv_id, max(d) AS d FROM p GROUP BY 1) USING (conv_id, d) GROUP BY 1)
SELECT k.conv_id, k.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM k LEFT JOIN v q ON q.name = k.parent JOIN t ON t.name = k.name LEFT JOIN e ON e.name = k.name"""

ORACLES["op13_line_dedup"] = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
k AS (SELECT doc_id, l, list_transform(l, lambda x: translate(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS k FROM l),
h AS (SELECT key FROM (SELECT doc_id, unnest(list_distinct(k)) AS key FROM k) WHERE length(key) >= 1 GROUP BY 1 HAVING count(*) >= 10),
p AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line, unnest(k) AS key FROM k)
SELECT doc_id, count(*) AS n_lines, count(h.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (h.key IS NULL), '')) AS kept_sha256
FROM p LEFT JOIN h USING (key) GROUP BY 1"""


def _kind(order: int, kind: str, pattern: str, group: int = 0, least: int = 0, length: int = 0, without: str = "") -> str:
    """Matches of one pattern with their positions: pieces between the matches, and the matches."""
    quoted = pattern.replace("'", "''")
    keep = f" AND length(value) >= {least}" if least else ""
    keep += f" AND length(found) = {length} AND NOT contains(found, '{without}')" if length else ""
    return f"""
  SELECT doc_id, {order} AS o, '{kind}' AS kind, begin, begin + length(found) AS finish, value FROM (
    SELECT doc_id, found, value, sum(length(gap)) OVER p + sum(length(found)) OVER p - length(found) AS begin FROM (
      SELECT doc_id, unnest(regexp_split_to_array(text, '{quoted}')[:len(regexp_extract_all(text, '{quoted}'))]) AS gap, unnest(regexp_extract_all(text, '{quoted}')) AS found,
        unnest(regexp_extract_all(text, '{quoted}', {group})) AS value, generate_subscripts(regexp_extract_all(text, '{quoted}'), 1) AS i FROM d)
    WINDOW p AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)) WHERE true{keep}"""


_NAMED = r"""["']?\x20*[:=]\x20*["']?"""
_PARTS = " UNION ALL ".join(
    [
        _kind(0, "assign", rf"((?i:password|passwd|secret|token|api_?key)){_NAMED}([A-Za-z0-9+/_.=-]+)", 2, 6),
        _kind(1, "access", "AKIA[A-Z0-9]+", 0, 18),
        _kind(2, "hex", "[0-9a-f]+", 0, 16),
        _kind(3, "id", rf"(?i:client_?id|account_?id|user_?name|user|login){_NAMED}([A-Za-z0-9._@-]{{3,}})"),
        _kind(4, "weak", "[A-Za-z0-9+/=]+", 0, 0, 40, "="),
        _kind(5, "endpoint", rf"""https?://[^\s"'<>]+|(?i:host|endpoint|server){_NAMED}[A-Za-z0-9.:-]+"""),
    ]
)

OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({_PARTS}),
part AS (SELECT doc_id, CASE WHEN kind = 'assign' AND length(value) < 12 THEN 4 ELSE o END AS o, CASE WHEN kind = 'assign' AND length(value) < 12 THEN 'weak' ELSE kind END AS kind, begin::BIGINT AS begin, finish::BIGINT AS finish FROM raw),
near AS (SELECT *,
  coalesce(begin - max(CASE WHEN kind IN ('id', 'access', 'endpoint') THEN finish END) OVER b <= 160, false) OR coalesce(min(CASE WHEN kind IN ('id', 'access', 'endpoint') THEN begin END) OVER a - finish <= 160, false) AS near_id,
  coalesce(begin - max(CASE WHEN kind IN ('assign', 'hex', 'weak') THEN finish END) OVER b <= 160, false) OR coalesce(min(CASE WHEN kind IN ('assign', 'hex', 'weak') THEN begin END) OVER a - finish <= 160, false) AS near_secret
  FROM part WINDOW b AS (PARTITION BY doc_id ORDER BY begin, finish, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY doc_id ORDER BY begin, finish, kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
kept AS (SELECT * FROM near WHERE o < 3 OR (kind = 'weak' AND near_id) OR (kind = 'id' AND near_secret)),
said AS (SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
  string_agg(kind || ':' || begin || ':' || finish, ',' ORDER BY begin, o) FILTER (o < 3) AS base, string_agg(kind || ':' || begin || ':' || finish, ',' ORDER BY begin, o) AS spans FROM kept GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN said USING (doc_id)"""

ORACLES["op8_secret_scan"] = OP8
