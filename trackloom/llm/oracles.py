"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

_SPACE = r"[ \t\n\x0b\f\r]+"

OP1 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) >= 3 THEN list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
both_ways AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, t.b FROM reach r JOIN both_ways t ON r.b = t.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""

OP2 = rf"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS words FROM documents),
t AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
v AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, unnest(list_transform(range(1, len(words) - 33), lambda i: array_to_string(list_slice(words, i, i + 34), ' '))) AS win FROM w WHERE len(words) >= 35),
r AS (SELECT win FROM v GROUP BY win HAVING count(*) > 1),
c AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM v JOIN r USING (win)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM t WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = t.doc_id AND c.p = t.p) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN g USING (doc_id)
"""

OP9 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, regexp_replace(coalesce(url, ''), '[\\x00-\\x20\\x7F]', '%20', 'g') AS url FROM pages),
h AS (SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS newest FROM p),
r AS (SELECT *, split_part(CASE WHEN strpos(url, '://') > 0 AND strpos(url, '://') + 2 < length(url) THEN substr(url, strpos(url, '://') + 3) ELSE url END, '#', 1) AS rest FROM h),
s AS (SELECT *, split_part(rest, '/', 1) AS host, substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM r),
k AS (
  SELECT *, array_to_string(list_reverse(string_split(regexp_replace(lower(split_part(list_extract(string_split(host, '@'), -1), ':', 1)), '^www\\.', ''), '.')), ',')
    || ')' || path AS url_key,
  strftime(make_timestamp((1704067200 + page_id % 1000000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured FROM s)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> newest THEN newest END AS refers_to,
  url_key, captured, CAST(row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS BIGINT) AS position
FROM k
"""

_MARKS = r"^(?:[ \t]{0,3}>)+"
_NORMAL = r"trim(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\n]+', ' ', 'g'), ' ')"
_OWN = rf"regexp_replace(regexp_replace(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT regexp_matches(x, '{_MARKS}')), chr(10)), '^(?:[ \t\r]*\n)+', ''), '(?:\n[ \t\r]*)+$', '')"

OP10 = rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS i FROM conversations),
lines AS (SELECT conv_id, turn, i, length(regexp_replace(regexp_extract(raw, '{_MARKS}'), '[^>]', '', 'g')) AS level, {_NORMAL.format(x=f"regexp_replace(raw, '{_MARKS} ?', '')")} AS unit FROM raw),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY i) AS run FROM lines WHERE unit <> ''),
passages AS (SELECT conv_id, turn, level, string_agg(unit, ' ' ORDER BY i) AS unit FROM runs GROUP BY conv_id, turn, level, run),
units AS (SELECT conv_id, turn, level, unit FROM lines WHERE unit <> '' UNION ALL SELECT conv_id, turn, level, unit FROM passages
  UNION ALL SELECT conv_id, turn, 0 AS level, {_NORMAL.format(x=_OWN)} AS unit FROM conversations),
offers AS (SELECT conv_id, unit, min(turn) AS source FROM units WHERE level = 0 AND unit <> '' GROUP BY conv_id, unit),
hits AS (SELECT u.conv_id, u.turn, u.level, source, sum(length(u.unit)) AS votes FROM units u JOIN offers o ON u.conv_id = o.conv_id AND u.unit = o.unit WHERE u.level > 0 AND source < turn GROUP BY u.conv_id, u.turn, u.level, source),
links AS (SELECT conv_id, turn, source AS parent_turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, votes DESC, source DESC) AS rn FROM hits) AS h WHERE rn = 1),
up(conv_id, turn, root) AS (SELECT conv_id, turn, parent_turn FROM links UNION ALL SELECT up.conv_id, up.turn, l.parent_turn FROM up JOIN links l ON up.conv_id = l.conv_id AND up.root = l.turn),
roots AS (SELECT conv_id, turn, min(root) AS root FROM up GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, c.role, {_OWN} AS text,
  CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_MARKS}'))) AS BIGINT) AS n_quoted, parent_turn, coalesce(root, c.turn) AS thread_turn
FROM conversations c LEFT JOIN links l ON c.conv_id = l.conv_id AND c.turn = l.turn LEFT JOIN roots r ON c.conv_id = r.conv_id AND c.turn = r.turn
"""
