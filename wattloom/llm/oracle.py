"""DuckDB SQL for the queries whose contract SQL can express in full."""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Operator 6: windows of ten item words found in document windows by equality.
_LEAKS = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS ws FROM documents),
 i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOW}, '{_WORD}') AS ws FROM benchmark),
 iw AS (SELECT item, least(10, len(ws)) AS w, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS s, ws FROM i WHERE len(ws) > 0),
 win AS (SELECT DISTINCT item, w, list_slice(ws, s, s + w - 1) AS g FROM iw),
 widths AS (SELECT DISTINCT w FROM win),
 dw AS (SELECT doc_id, w, unnest(range(1, len(ws) - w + 2)) AS s, ws FROM d, widths WHERE len(ws) >= w),
 dg AS (SELECT doc_id, w, s, list_slice(ws, s, s + w - 1) AS g FROM dw),
 hit AS (SELECT doc_id, s, dg.w, item FROM dg JOIN win ON dg.w = win.w AND dg.g = win.g),
 pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + w)) AS p FROM hit) GROUP BY 1),
 its AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS h FROM hit GROUP BY 1)"""

_SQL_LEAKS = f"{_LEAKS} SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"

#: Operator 2: matches and the text between them, by rule; starts are running sums of their lengths.
def _secrets() -> str:
    from .secrets import BASE_RULES, RULES

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    each = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS rank, {quoted(r.kind)} AS kind, string_split_regex(t, {quoted(r.regex)}) AS gaps, regexp_extract_all(t, {quoted(r.regex)}) AS found, regexp_extract_all(t, {quoted(r.regex)}, {r.group}) AS vals, {max(1, r.least)} AS least FROM d WHERE regexp_matches(t, {quoted(r.regex)})"
        for i, r in enumerate(RULES)
    )
    text = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
    base = f"rank < {len(BASE_RULES)}"
    n = ", ".join(f"count_if(kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    zero = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({each}),
 u AS (SELECT doc_id, rank, kind, least, unnest(list_slice(gaps, 1, len(found))) AS gap, unnest(found) AS hit, unnest(vals) AS val, unnest(range(1, len(found) + 1)) AS i FROM m),
 p AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop0 FROM u),
 s AS (SELECT doc_id, rank, kind, CAST(stop0 - length(hit) AS BIGINT) AS start, CAST(stop0 AS BIGINT) AS stop FROM p WHERE length(val) >= least),
 a AS (SELECT doc_id, {n}, {text} AS spans, {text.replace('start, rank)', f'start, rank) FILTER ({base})')} AS base FROM s GROUP BY doc_id)
 SELECT d.doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (doc_id)"""


#: Operator 12: CRC-32 a bit a step, then every prefix of every rebuilt conversation, and every node below every prefix.
_TRIE = r"""WITH RECURSIVE own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
 crc AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM own
  UNION ALL
  SELECT conv_id, s, k + 1, xor(x >> 1, 3988292384 * (x & 1)) FROM (
   SELECT conv_id, s, k, CASE WHEN k % 8 = 0 THEN xor(c, CAST(ascii(substr(s, CAST(k // 8 + 1 AS BIGINT), 1)) AS BIGINT)) ELSE c END AS x FROM crc WHERE k < 8 * length(s))),
 h AS (SELECT conv_id, xor(c, 4294967295) % 4 AS h FROM crc WHERE k = 8 * length(s)),
 seq AS (
  SELECT o.conv_id, list_concat(list_slice(coalesce(b.ts, []), 1, h.h), list_slice(o.ts, h.h + 1, len(o.ts))) AS ts
  FROM own o JOIN h USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - (o.conv_id % 20 + 20) % 20),
 member AS (SELECT conv_id, d, list_slice(ts, 1, d) AS k, len(ts) = d AS ends FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM seq)),
 node AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM member GROUP BY d, k),
 child AS (SELECT d - 1 AS d, list_slice(k, 1, d - 1) AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
 full_node AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(k[-1].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM node n LEFT JOIN child USING (d, k)),
 up AS (SELECT list_slice(k, 1, a) AS k, saved, CAST(n_children = 0 AS INT) AS leaf FROM (SELECT k, saved, n_children, unnest(range(0, d + 1)) AS a FROM full_node)),
 total AS (SELECT k, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY k)
 SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
 FROM full_node n JOIN total USING (k) LEFT JOIN node p ON p.d = n.d - 1 AND p.k = list_slice(n.k, 1, n.d - 1)"""


SQL: dict[str, str] = {"op2_secret_scan": _secrets(), "op6_decontamination": _SQL_LEAKS, "op12_conversation_trie": _TRIE}
