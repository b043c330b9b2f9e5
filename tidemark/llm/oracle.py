"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

OP1 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS size, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS owner FROM p)
SELECT page_id, size::BIGINT AS payload_bytes,
  array_to_string([substr('{_B32}', ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1) FOR i IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM d
"""

OP5 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s AS (SELECT *, length(text) + 3 * length(text) - length(replace(text, '\', '')) - length(replace(text, '#', '')) - length(replace(text, '<', '')) AS n_text,
  length(role) + 4 * length(role) - length(replace(role, '\', '')) - length(replace(role, '#', '')) - length(replace(role, '<', '')) - length(replace(role, ':', '')) AS n_role FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(14 + n_role + n_text)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""

OP10 = r"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM p),
u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM q),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) v(rule_host, rule_path, rule_verdict)),
m AS (SELECT page_id, host, path, rule_host || rule_path AS rule, rule_verdict FROM u LEFT JOIN r
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS k FROM m)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict FROM b WHERE k = 1
"""


# Exact distinct sites; Spark's sketch only decides which lines need them.
OP8 = r"""
WITH raw AS (SELECT doc_id, coalesce(source, chr(1)) AS site, text, row_number() OVER () AS row FROM documents),
l AS (SELECT row, site, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM raw),
t AS (SELECT row, site, pos, line AS full_line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM l),
w AS (SELECT * FROM t WHERE line <> '' AND len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 4),
b AS (SELECT line FROM w GROUP BY line HAVING count(DISTINCT site) >= 5),
h AS (SELECT row, pos, length(line) AS n FROM w WHERE line IN (SELECT line FROM b)),
s AS (SELECT row, sum(n) AS chars, count(*) AS n_lines FROM h GROUP BY row),
c AS (SELECT t.row, string_agg(t.full_line, chr(10) ORDER BY t.pos) AS cleaned FROM t ANTI JOIN h ON t.row = h.row AND t.pos = h.pos GROUP BY t.row),
d AS (SELECT raw.*, s.chars, s.n_lines, c.cleaned, s.chars IS NOT NULL AND regexp_matches(coalesce(c.cleaned, ''), '[^\x20\x09-\x0D]') AS removes FROM raw LEFT JOIN s USING (row) LEFT JOIN c USING (row)),
o AS (SELECT doc_id, removes, chars, n_lines, CASE WHEN removes THEN cleaned ELSE text END AS text FROM d)
SELECT doc_id, CASE WHEN removes THEN n_lines ELSE 0 END::BIGINT AS n_lines_removed, CASE WHEN removes THEN chars ELSE 0 END::BIGINT AS n_chars_removed,
  length(text)::BIGINT AS n_chars_kept, sha256(text) AS text_sha256
FROM o
"""


def _op12(rounds: int = 6) -> str:
    """Lloyd's rounds as a chain of CTEs over whole numbers: an assignment and new entries a round."""
    ctes = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)",
        "pieces AS MATERIALIZED (SELECT row, part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] AS p FROM kept, range(8) r(part))",
        "ranked AS (SELECT row, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS entry FROM kept)",
        "book0 AS MATERIALIZED (SELECT part, entry, p AS e FROM ranked JOIN pieces USING (row) WHERE entry < 16)",
    ]
    for i in range(rounds + 1):
        ctes.append(f"near{i} AS MATERIALIZED (SELECT row, part, min({{d: list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(p, e)])::BIGINT, entry: entry}}) AS best FROM pieces JOIN book{i} USING (part) GROUP BY row, part)")
        if i < rounds:
            ctes.append(f"mean{i} AS (SELECT part, entry, list(m ORDER BY place) AS m FROM (SELECT part, best.entry AS entry, place, floor(sum(p[place]) / count(*)::DOUBLE)::BIGINT AS m FROM near{i} JOIN pieces USING (row, part), range(1, 1 + (SELECT max(len(p)) FROM pieces)) r(place) GROUP BY ALL) GROUP BY part, entry)")
            ctes.append(f"book{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m, e) AS e FROM book{i} b LEFT JOIN mean{i} m ON m.part = b.part AND m.entry = b.entry)")
    ctes.append(f"coded AS MATERIALIZED (SELECT row, string_agg('0' || substr('0123456789abcdef', best.entry::INT + 1, 1), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY row)")
    return f"""WITH {', '.join(ctes)}
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256 FROM coded JOIN kept USING (row)"""


OP12 = _op12()


# CRC-32 from its definition: a table of 256 remainders, then a byte at a time.
_CRC = """bits(i, k, v) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END FROM bits WHERE k < 8),
crcs AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8)"""


def _crc(text: str) -> str:
    return f"xor(list_reduce([ascii(x)::BIGINT FOR x IN string_split({text}, '')], lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


# A node is its first d turns as a list; its subtree are the nodes whose first members pass through it.
OP13 = f"""
WITH RECURSIVE {_CRC},
own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc('conv_id::VARCHAR')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM own), crcs),
rebuilt AS (SELECT c.conv_id, pos, role, text FROM convs c JOIN own o ON o.conv_id = base AND pos <= h UNION ALL SELECT c.conv_id, pos, role, text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND pos > h),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS d, role, text FROM rebuilt),
paths AS MATERIALIZED (SELECT conv_id, d, text, list({{r: role, t: text}}) OVER (PARTITION BY conv_id ORDER BY d) AS p, d = count(*) OVER (PARTITION BY conv_id) AS is_end FROM placed
  UNION ALL SELECT conv_id, 0, '', [], conv_id NOT IN (SELECT conv_id FROM placed) FROM convs),
member AS MATERIALIZED (SELECT conv_id, d, min(conv_id) OVER (PARTITION BY d, p) AS node FROM paths),
nodes AS MATERIALIZED (SELECT d AS depth, node, count(*) AS n, any_value(strlen(text)) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256 FROM paths JOIN member USING (conv_id, d) GROUP BY ALL),
linked AS MATERIALIZED (SELECT n.*, m.node AS parent FROM nodes n LEFT JOIN member m ON m.conv_id = n.node AND m.d = n.depth - 1),
kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
full_ AS MATERIALIZED (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN kids USING (node, depth)),
below AS (SELECT m.d AS depth, m.node, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n - 1) * f.bytes)::BIGINT AS saved_tokens FROM full_ f JOIN member m ON m.conv_id = f.node AND m.d <= f.depth GROUP BY ALL)
SELECT node AS conv_id, depth, parent AS parent_conv_id, n AS n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM full_ JOIN below USING (node, depth)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1, "op5_chat": OP5, "op8_lines": OP8, "op10_urls": OP10, "op12_elkan": OP12, "op13_prefixes": OP13}
