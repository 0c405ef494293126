"""DuckDB SQL for the rows of the queries that SQL can express."""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS drawn
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM d GROUP BY source),
u AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER w, 0.0::DOUBLE) AS words_left,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0::DOUBLE) AS weight_left,
         row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, place) AS turn
  FROM s
  WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT *, (SELECT arg_min(words_left / weight_left, turn) FROM u WHERE cap * weight_left > weight * words_left) AS level FROM u),
t AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, weight * level) END AS target FROM l),
g AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
h AS (SELECT *, CAST(round(target) AS BIGINT) - whole * source_size AS extra FROM g),
r AS (
  SELECT source, drawn, CAST(sum(size) AS BIGINT) AS tied,
         CAST(sum(sum(size)) OVER (PARTITION BY source ORDER BY drawn) AS BIGINT) AS upto
  FROM d GROUP BY source, drawn)
SELECT d.doc_id, d.size, h.source_size, h.target,
       CAST(h.whole * d.size + CASE
         WHEN h.extra <= 0 THEN 0
         WHEN r.upto <= h.extra THEN d.size
         WHEN r.upto - r.tied <= h.extra THEN CAST(floor(d.size * ((h.extra - r.upto + r.tied)::DOUBLE / r.tied)) AS BIGINT)
         ELSE 0 END AS BIGINT) AS taken
FROM d
JOIN h ON d.source IS NOT DISTINCT FROM h.source
JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.drawn = r.drawn
"""

HOST = r"""coalesce(translate(regexp_extract(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"""

URLS = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, html, {HOST} AS host,
         coalesce(regexp_extract(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, h, pre) AS (VALUES
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
j AS (
  SELECT page_id, html, host, path,
         (SELECT arg_max(struct_pack(rule := h || pre, verdict := verdict), struct_pack(n := length(h) + length(pre), s := h || pre))
          FROM rules WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, pre)) AS best
  FROM p),
raw AS (
  SELECT host AS a, unnest(regexp_extract_all(html, '(?i)<a\s(?:[^<>]*?\s)?href\s*=\s*["'']?\s*((?:https?:)?//[^"''\s>]*)', 1)) AS url FROM p),
far AS (SELECT a, CASE WHEN starts_with(url, '//') THEN 'http:' || url ELSE url END AS url FROM raw),
links AS (SELECT a, b, count(*) AS n FROM (SELECT a, {HOST} AS b FROM far) WHERE a <> '' AND b <> '' AND a <> b GROUP BY a, b),
hosts AS (
  SELECT host, sum(allowed) AS allowed, sum(blocked) AS blocked FROM (
    SELECT host, count(*) FILTER (best.verdict = 'allow') AS allowed, count(*) FILTER (best.verdict = 'block') AS blocked FROM j GROUP BY host
    UNION ALL SELECT DISTINCT b, 0, 0 FROM links) GROUP BY host),
seeds AS (
  SELECT host, 'trust' AS kind, allowed::DOUBLE / greatest((SELECT sum(allowed) FROM hosts), 1)::DOUBLE AS seed FROM hosts
  UNION ALL SELECT host, 'distrust', blocked::DOUBLE / greatest((SELECT sum(blocked) FROM hosts), 1)::DOUBLE FROM hosts),
edges AS (
  SELECT a AS host, 'trust' AS kind, b AS goal, n / sum(n) OVER (PARTITION BY a) AS part FROM links
  UNION ALL SELECT b, 'distrust', a, n / sum(n) OVER (PARTITION BY b) FROM links),
ranks(round, host, kind, score) AS (
  SELECT 0, host, kind, seed FROM seeds
  UNION ALL
  SELECT round + 1, host, kind, sum(score) FROM (
    SELECT r.round, s.host, s.kind, s.seed AS score FROM ranks r JOIN seeds s ON r.host = s.host AND r.kind = s.kind
    UNION ALL
    SELECT r.round, e.goal, e.kind, 0.85::DOUBLE * r.score * e.part FROM ranks r JOIN edges e ON r.host = e.host AND r.kind = e.kind)
  WHERE round < 20 GROUP BY round, host, kind),
final AS (
  SELECT host, sum(score) FILTER (kind = 'trust') AS trust, sum(score) FILTER (kind = 'distrust') AS distrust FROM ranks WHERE round = 20 GROUP BY host)
SELECT page_id, j.host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN final USING (host)
"""

_BLOCKS = "p|div|li|ul|ol|dl|dt|dd|h[1-6]|br|hr|tr|td|th|table|nav|article|section|header|footer|title|body|html|head|main|aside|blockquote|pre|form"
_SPACE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"

LINES = rf"""
WITH p AS (
  SELECT page_id, {HOST} AS host,
         list_filter(list_transform(string_split(
           regexp_replace(regexp_replace(regexp_replace(html,
             '(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)', '', 'g'),
             '(?i)</?(?:{_BLOCKS})\b[^<>]*>', chr(10), 'g'), '<[^<>]*>', '', 'g'),
           chr(10)), lambda x: regexp_replace(x, '{_SPACE}', '', 'g')), lambda x: x <> '') AS lines
  FROM pages),
c AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host HAVING count(*) >= 5),
b AS (SELECT host, list(line) AS bad FROM c JOIN t USING (host) WHERE n > 0.3::DOUBLE * pages GROUP BY host)
SELECT page_id, host, coalesce(len(lines), 0)::BIGINT AS n_lines,
       coalesce(len(lines) - len(list_filter(lines, lambda x: NOT coalesce(list_contains(bad, x), false))), 0)::BIGINT AS n_dropped,
       array_to_string(list_filter(lines, lambda x: NOT coalesce(list_contains(bad, x), false)), chr(10)) AS text
FROM p LEFT JOIN b USING (host)
"""

#: All pairs: for tables as small as the ones it is tested on.
EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT * FROM (
    SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)
  WHERE n > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.95::DOUBLE),
r(node, root) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = node LEFT JOIN n ON vec_id = a
"""

SQL = {"op1_mixing": MIXING, "op3_embedding_dedup": EMBEDDINGS, "op2_url_filter": URLS, "op9_line_dedup": LINES}
