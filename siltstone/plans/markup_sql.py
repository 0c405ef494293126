"""SQL of queries over markup, splitters and rates: recursive where the operator goes from row to row."""

from __future__ import annotations

from ..functions.splitters import OVERLAP, SIZE, SLACK

NL2 = "repeat(chr(10), 2)"
STRIP = r"'^\s+|\s+$'"
HREFS = """regexp_extract_all(html, '<a href="([^"]*)"', 1)"""
NOWHERE = r"regexp_matches(href, '^\s*(#|javascript:|mailto:|tel:|data:|$)')"


def unescaped(text: str) -> str:
    return f"replace(replace(replace(replace({text}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&')"


def stripped(text: str) -> str:
    return f"regexp_replace({text}, {STRIP}, '', 'g')"


#: The pages' articles hold a heading, a bold line that is not closed, and paragraphs, if any: alone, it is bold.
ARTICLE = "regexp_extract(html, '(?s)<article>(.*)</article>', 1)"
MARKED = rf"""regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace({ARTICLE}, '\s+', ' ', 'g'), '<b>\s*([^<]*?)\s*<br>\s*(</p>)?\s*$', '**\1**\2'),
  '<h1>', {NL2} || '# '), '</h1>', {NL2}), '<br>', chr(10)), '</?p>', {NL2}, 'g'), '</?b>', '', 'g')"""
PAGE = rf"""m AS (SELECT *, {stripped(rf"regexp_replace(regexp_replace({unescaped(MARKED)}, '[ \t]*\n[ \t]*', chr(10), 'g'), '\n{{3,}}', {NL2}, 'g')")} AS content FROM pages),
  md AS (SELECT page_id, url, html, {stripped(unescaped("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"))} AS title, content,
    substr(list_filter(string_split(content, {NL2}), lambda x: x <> '' AND NOT starts_with(x, '#'))[1], 1, 200) AS excerpt FROM m)"""


def packed(full: str) -> str:
    """Parts (doc_id, sep, list) put together until ``full``, which sees r.held bytes, r.lines parts, and the part p."""
    return f"""parts AS (SELECT doc_id, sep, unnest(range(len(list))) AS k, unnest(list) AS part FROM cut),
  r AS (
    SELECT doc_id, k, strlen(part) AS held, 1 AS lines, 0 AS g FROM parts WHERE k = 0
    UNION ALL
    SELECT p.doc_id, p.k, CASE WHEN {full} THEN strlen(p.part) ELSE r.held + strlen(p.sep) + strlen(p.part) END, CASE WHEN {full} THEN 1 ELSE r.lines + 1 END, r.g + ({full})::INT
    FROM r JOIN parts p ON p.doc_id = r.doc_id AND p.k = r.k + 1),
  packed AS (SELECT doc_id, g, replace(array_to_string(list(part ORDER BY k), chr(1)), chr(1), any_value(sep)) AS content FROM r JOIN parts USING (doc_id, k) GROUP BY doc_id, g)"""


def whole_character(at: str) -> str:
    """A place in ``h``, two digits a byte, or the next one that does not continue a character (of four bytes at most)."""
    continues = lambda k: f"substr(h, 2 * ({at} + {k}) + 1, 1) IN ('8', '9', 'A', 'B')"
    return f"CASE WHEN NOT {continues(0)} THEN {at} WHEN NOT {continues(1)} THEN {at} + 1 WHEN NOT {continues(2)} THEN {at} + 2 ELSE {at} + 3 END"


#: Windows of bytes that end at the first white space within 100 bytes after the limit.
WINDOWS = rf"""d AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM documents WHERE text <> ''),
  w(doc_id, start, stop) AS (
    SELECT doc_id, 0::BIGINT, NULL::BIGINT FROM d
    UNION ALL
    SELECT doc_id, start, CASE WHEN cut < n AND regexp_matches(ahead, '^(..)*?(09|0A|0B|0C|0D|20)')
        THEN cut + length(regexp_extract(ahead, '^((?:..)*?)(?:09|0A|0B|0C|0D|20)', 1)) // 2 ELSE cut END FROM (
      SELECT doc_id, start, n, cut, substr(h, 2 * cut + 1, 200) AS ahead FROM (
        SELECT *, least({whole_character(f"(start + {SIZE})")}, n) AS cut FROM (
          SELECT doc_id, h, n, CASE WHEN stop IS NULL THEN 0 WHEN back > start THEN back ELSE stop END AS start FROM (
            SELECT w.*, h, n, {whole_character(f"(stop - {OVERLAP})")} AS back FROM w JOIN d USING (doc_id) WHERE stop IS NULL OR stop < n))))),
  bare AS (SELECT doc_id, start, {stripped("decode(unhex(substr(h, 2 * start + 1, 2 * (stop - start))))")} AS content FROM w JOIN d USING (doc_id) WHERE stop IS NOT NULL),
  pieces AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::BIGINT AS n, content FROM bare WHERE content <> '')"""


def last_mark(digits: str) -> str:
    """Bytes before the last such mark in ``ahead``, or null."""
    return f"CASE WHEN regexp_matches(ahead, '^(..)*{digits}') THEN length(regexp_extract(ahead, '^((?:..)*){digits}', 1)) // 2 END"


#: A page's Markdown is one section; its windows end after the last blank line, or line feed, before 1,700 bytes.
SECTION_WINDOWS = rf"""d AS (SELECT page_id, content, hex(encode(content)) AS h, strlen(content) AS n FROM md),
  w(page_id, start, stop) AS (
    SELECT page_id, 0::BIGINT, NULL::BIGINT FROM d
    UNION ALL
    SELECT page_id, start, CASE WHEN cut >= n THEN n WHEN two + 2 > {OVERLAP} THEN start + two + 2 WHEN one + 1 > {OVERLAP} THEN start + one + 1 ELSE cut END FROM (
      SELECT *, {last_mark('0A0A')} AS two, {last_mark('0A')} AS one FROM (
        SELECT *, substr(h, 2 * start + 1, 2 * (least({whole_character(f"(start + {SIZE + SLACK})")}, n) - start)) AS ahead FROM (
          SELECT *, least({whole_character(f"(start + {SIZE})")}, n) AS cut FROM (
            SELECT page_id, h, n, CASE WHEN stop IS NULL THEN 0 ELSE greatest(back, start + 1) END AS start FROM (
              SELECT w.*, h, n, {whole_character(f"(stop - {OVERLAP})")} AS back FROM w JOIN d USING (page_id) WHERE stop IS NULL OR stop < n)))))),
  pieces AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY start) - 1 AS n, decode(unhex(substr(h, 2 * start + 1, 2 * (stop - start)))) AS content,
    trim(regexp_extract(d.content, '^#([^\n]*)', 1)) AS path FROM w JOIN d USING (page_id) WHERE stop IS NOT NULL)"""

#: A bucket of 60 requests and one of 20,000 tokens a minute, filled as time goes, and 0.1 s between requests.
CJK = r"[\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}]"
TOKENS = f"(greatest(1, (length(text) - length(regexp_replace(text, '{CJK}', '', 'g'))) + greatest(1, length(regexp_replace(text, '{CJK}', '', 'g')) // 4)) + 5)::BIGINT"

STREAMS = {
    "index_pages": f"WITH RECURSIVE {PAGE}, {SECTION_WINDOWS} SELECT page_id, n::INTEGER AS sort_order, content, 1 AS level, 64::BIGINT AS dim FROM pieces",
    "progress_throttle": """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6::DOUBLE AS "at", row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
      r AS (SELECT user_id, n, "at", true AS sent, "at" AS last FROM e WHERE n = 1
        UNION ALL SELECT e.user_id, e.n, e."at", e.n <= 5 OR e."at" - r.last >= 7200, CASE WHEN e.n <= 5 OR e."at" - r.last >= 7200 THEN e."at" ELSE r.last END
        FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
      SELECT user_id, "at" FROM r WHERE sent""",
    "rate_limit_sim": f"""WITH RECURSIVE d AS (SELECT source AS key, doc_id * 0.05::DOUBLE AS "at", {TOKENS} AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
      r AS (
        SELECT key, n, "at", tokens, "at" AS now, 59.0::DOUBLE AS req, 20000.0::DOUBLE - least(tokens, 20000) AS tok FROM d WHERE n = 1
        UNION ALL
        SELECT key, n, "at", tokens, came + wait, least(60.0::DOUBLE, full_req + wait) - 1, least(20000.0::DOUBLE, full_tok + wait / 60 * 20000) - least(tokens, 20000) FROM (
          SELECT *, greatest(0.0::DOUBLE, ready - came, CASE WHEN full_req < 1 THEN 1 - full_req ELSE 0 END,
            CASE WHEN full_tok < least(tokens, 20000) THEN (least(tokens, 20000) - full_tok) * 60 / 20000 ELSE 0 END) AS wait FROM (
            SELECT d.key, d.n, d."at", d.tokens, greatest(r.now, d."at") AS came, r.now + 0.1::DOUBLE AS ready,
              least(60.0::DOUBLE, r.req + greatest(r.now, d."at") - r.now) AS full_req,
              least(20000.0::DOUBLE, r.tok + (greatest(r.now, d."at") - r.now) / 60 * 20000) AS full_tok
            FROM r JOIN d ON d.key = r.key AND d.n = r.n + 1)))
      SELECT key, round("at", 2) AS "at", tokens, round(now - "at", 3) AS waited FROM r""",
}


def values(rows: list[tuple[str, str]]) -> str:
    return ", ".join("('" + "', '".join(x.replace("'", "''") for x in row) + "')" for row in rows)


def texts(site: list[tuple[str, str]], code: list[tuple[str, str]]) -> dict[str, str]:
    return {
        # In these programs every line that begins with a letter begins a block.
        "split_code": rf"""WITH code(language, code) AS (VALUES {values(code)}),
          l AS (SELECT language, unnest(range(len(string_split(code, chr(10))))) AS k, unnest(string_split(code, chr(10))) AS line FROM code),
          g AS (SELECT *, sum(regexp_matches(line, '^[a-z]')::INT) OVER (PARTITION BY language ORDER BY k) AS g FROM l),
          b AS (SELECT language, g, string_agg(line, chr(10) ORDER BY k) AS block FROM g GROUP BY language, g),
          n AS (SELECT *, regexp_extract(block, '^(?:export )?(?:fn|struct|impl|def|class|function|const|func|type)\s+(?:\([^)]*\)\s*)?(\w+)', 1) AS name FROM b)
          SELECT language, (g - 1)::BIGINT AS n, regexp_replace(block, '^\n+|\n+$', '', 'g') AS content,
            CASE WHEN name = '' THEN 0 WHEN starts_with(block, 'func (') THEN 2 ELSE 1 END AS level, CASE WHEN name = '' THEN 'module' ELSE name END AS path, 'code,' || language AS types FROM n""",
        "main_text": rf"""SELECT page_id, {stripped(rf"regexp_replace(regexp_replace({unescaped(f"regexp_replace({ARTICLE}, '<[^>]*>', '', 'g')")}, '[ \t\r\f\v]+', ' ', 'g'), '\n\s*\n+', {NL2}, 'g')")} AS text FROM pages""",
        "html_to_markdown": f"WITH {PAGE} SELECT page_id, title, content, excerpt FROM md",
        "process_pages": f"WITH {PAGE} SELECT page_id, url, title, content, len(list_distinct(list_filter({HREFS}, lambda href: NOT {NOWHERE})))::BIGINT AS n_links FROM md",
        "crawl_bfs": rf"""WITH RECURSIVE s(url, html) AS (VALUES {values(site)}),
          link AS (SELECT url AS a, CASE WHEN starts_with(href, '/') THEN 'https://s.test' || href ELSE href END AS b FROM (SELECT url, unnest(regexp_extract_all(html, 'href=''([^'']*)''', 1)) AS href FROM s)),
          r(url, depth) AS (SELECT 'https://s.test/', 0 UNION SELECT b, depth + 1 FROM r JOIN link ON a = url WHERE depth < 2 AND starts_with(b, 'https://s.test/')),
          p AS (SELECT url, html, min(depth) AS depth FROM r JOIN s USING (url) GROUP BY url, html),
          b AS (SELECT *, replace(regexp_replace(regexp_extract(html, '<main>(.*)</main>', 1), '<a href=''([^'']*)''>([^<]*)</a>', '[\2](\1)', 'g'), '<h1>', '# ') AS main FROM p)
          SELECT url, depth, regexp_extract(html, '<title>(.*)</title>', 1) AS title,
            {stripped(rf"regexp_replace(regexp_replace(main, '</?(h1|p)>', {NL2}, 'g'), '\n{{3,}}', {NL2}, 'g')")} AS content FROM b""",
        "split_separators": rf"""WITH RECURSIVE d AS (SELECT doc_id, text, CASE WHEN strlen(text) <= {SIZE} THEN chr(0) WHEN contains(text, {NL2}) THEN {NL2} WHEN contains(text, chr(10)) THEN chr(10) WHEN contains(text, '. ') THEN '. ' ELSE ' ' END AS sep FROM documents),
          cut AS (SELECT doc_id, sep, string_split(text, sep) AS list FROM d), {packed(f"(r.held > 0 AND r.held + strlen(p.sep) + strlen(p.part) > {SIZE})")},
          bare AS (SELECT doc_id, g, {stripped("content")} AS content FROM packed)
          SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1)::BIGINT AS n, content, 0 AS level, '' AS path, 'text' AS types FROM bare WHERE content <> ''""",
        "split_code_lines": rf"""WITH RECURSIVE b AS (SELECT doc_id, regexp_replace(text, '^\n+|\n+$', '', 'g') AS text FROM documents),
          cut AS (SELECT doc_id, chr(10) AS sep, CASE WHEN strlen(text) <= {SIZE} THEN [text] ELSE string_split(text, chr(10)) END AS list FROM b WHERE {stripped("text")} <> ''),
          {packed(f"(r.held + 1 + strlen(p.part) + 1 > {SIZE} OR r.lines >= 100)")}
          SELECT doc_id, g::BIGINT AS n, content, 0 AS level, 'module' AS path, 'code,go' AS types FROM packed""",
        "split_text": f"WITH RECURSIVE {WINDOWS} SELECT doc_id, n, content, 0 AS level, '' AS path, 'text' AS types FROM pieces",
        "split_markdown": f"WITH RECURSIVE {PAGE}, {SECTION_WINDOWS} SELECT page_id, n::BIGINT AS n, content, 1 AS level, path, 'text' AS types FROM pieces",
        "split_in_sql": f"WITH RECURSIVE {WINDOWS} SELECT doc_id, n, content, 0 AS level, '' AS path, 'text' AS types FROM pieces",
        "embed_chunks": f"WITH RECURSIVE {WINDOWS} SELECT doc_id, n, 64::BIGINT AS dim FROM pieces",
    }
