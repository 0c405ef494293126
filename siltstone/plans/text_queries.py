"""Text, HTML, URL, splitter and embedding queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import html, splitters, text, urls
from ..operators import crawl, embedding
from ..session import load, spread
from . import markup_sql

MARKDOWN = "# One\nintro\n## Two\ntext\n### Three\n#### \n##Tight\n####### seven\nplain # text\n## Again"
CODE = [
    ("rust", "use std::io;\n\nfn main() {\n    println!(\"hi\");\n}\n\nstruct Point {\n    x: i32,\n}\n\nimpl Point {\n    fn new() -> Self { Point { x: 0 } }\n}\n"),
    ("python", "import os\n\ndef hello():\n    return 1\n\nclass Person:\n    def name(self):\n        return 'x'\n"),
    ("javascript", "export function add(a, b) {\n  return a + b;\n}\nconst f = (x) => {\n  return x;\n};\n"),
    ("go", "package main\n\nfunc (p *P) Get() int {\n\treturn 1\n}\n\ntype T struct {\n\tx int\n}\n"),
]
SITE = [
    ("https://s.test/", "<html><title>Home</title><body><main><h1>Home</h1><p>start</p><a href='/a'>A</a><a href='/b#x'>B</a><a href='https://other.test/z'>Z</a></main></body></html>"),
    ("https://s.test/a", "<html><title>A</title><body><main><h1>A</h1><p>page a</p><a href='/c'>C</a><a href='/'>home</a></main></body></html>"),
    ("https://s.test/b#x", "<html><title>B</title><body><main><p>page b</p><a href='/d'>D</a></main></body></html>"),
    ("https://s.test/c", "<html><title>C</title><body><main><p>page c</p><a href='/e'>E</a></main></body></html>"),
    ("https://s.test/d", "<html><title>D</title><body><main><p>page d</p></main></body></html>"),
    ("https://s.test/e", "<html><title>E</title><body><main><p>page e</p></main></body></html>"),
]


def _texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of long texts, on all cores."""
    return spread(load(spark, sf, name))


def _lines(spark: SparkSession) -> DataFrame:
    one = spark.range(1).select(F.posexplode(text.lines(F.lit(MARKDOWN))).alias("n", "line"))
    return one.select(F.col("n").cast("long").alias("n"), "line")


def estimate_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


def batch_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf, "documents").groupBy("source").agg(F.sum(text.estimate_tokens(F.col("text"))).alias("tokens"))


def text_lengths(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return _texts(spark, sf, "documents").select("doc_id", text.char_length(t).alias("chars"), text.byte_length(t).alias("bytes"), text.char_length(text.trim_all(t)).alias("trimmed"), F.md5(F.lower(t)).alias("lower"))


def preview(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf, "documents").select("doc_id", text.preview(F.col("text"), 200).alias("p200"), text.escape_html(text.preview(F.col("text"), 300)).alias("p300"))


def newline_collapse(spark: SparkSession, sf: str) -> DataFrame:
    wide = F.concat(F.lit("\n\n"), F.regexp_replace("text", "\n", "\n\n\n\n\n"), F.lit("\n"))
    return _texts(spark, sf, "documents").select("doc_id", text.collapse_newlines(wide).alias("text"))


def atx_headers(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark).select("n", text.heading_level(F.col("line")).alias("level"), text.heading_title(F.col("line")).alias("title"))


def heading_path(spark: SparkSession, sf: str) -> DataFrame:
    """The titles above each line: the last of each level, unless a higher one came since."""
    rows = _lines(spark).select("n", text.heading_level(F.col("line")).alias("level"), text.heading_title(F.col("line")).alias("title"))
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # the lines of one text
    at = lambda k: F.last(F.when(F.col("level") == k, F.col("n")), True).over(w)
    name = lambda k: F.last(F.when(F.col("level") == k, F.col("title")), True).over(w)
    a1, a2, a3 = at(1), at(2), at(3)
    p2 = F.when(a2 > F.coalesce(a1, F.lit(-1)), name(2))
    p3 = F.when(a3 > F.greatest(F.coalesce(a1, F.lit(-1)), F.coalesce(a2, F.lit(-1))), name(3))
    return rows.select("n", F.concat_ws(" > ", name(1), p2, p3).alias("path"))


def brace_balance(spark: SparkSession, sf: str) -> DataFrame:
    delta = text.count_of(F.col("html"), "{") - text.count_of(F.col("html"), "}") + 1
    one = F.substring_index(F.substring_index(F.col("url"), "://", -1), "/", 1)
    w = Window.partitionBy("host").orderBy("page_id").rowsBetween(Window.unboundedPreceding, 0)
    return _texts(spark, sf, "pages").select(one.alias("host"), "page_id", delta.alias("d")).select("page_id", F.sum("d").over(w).alias("balance"))


def json_path(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("[]")).alias("k"), F.coalesce(F.get_json_object("props", "$.path"), F.lit("[]")).alias("path"))


def parse_model_spec(spark: SparkSession, sf: str) -> DataFrame:
    specs = ["OpenAI:text-embedding-3-large", "google", "openai", "text-embedding-004", "google:embedding-001"]
    return spark.createDataFrame([(s, *embedding.parse_model(s)) for s in specs], "spec string, provider string, model string")


def url_resolve_rooted(spark: SparkSession, sf: str) -> DataFrame:
    p = _texts(spark, sf, "pages").select("page_id", "url", F.posexplode(html.hrefs_expr(F.col("html"))).alias("pos", "href"))
    return p.select("page_id", F.col("pos").cast("long").alias("pos"), urls.resolve_rooted(F.col("url"), F.col("href")).alias("target"))


def extract_links(spark: SparkSession, sf: str) -> DataFrame:
    p = _texts(spark, sf, "pages").select("page_id", "url", html.links_column(F.col("html"), F.col("url")).alias("l"))
    return p.select("page_id", F.size("l").cast("long").alias("links"), F.size(F.filter("l", lambda x: x["is_internal"])).cast("long").alias("internal"), F.element_at("l", 1)["url"].alias("first"))


def extract_links_fewer_skips(spark: SparkSession, sf: str) -> DataFrame:
    """The wider extraction, over pages that also link to mail, a telephone and a place within."""
    more = F.concat("html", F.lit('<a href="mailto:a@b.c">m</a><a href="tel:1">t</a><a href="#x">x</a><a href="javascript:void(0)">j</a>'))
    p = _texts(spark, sf, "pages").select("page_id", html.links_column(more, F.col("url"), html.FEWER).alias("l"))
    return p.select("page_id", F.size("l").cast("long").alias("links"), F.element_at("l", -1)["url"].alias("last"))


def split_in_sql(spark: SparkSession, sf: str) -> DataFrame:
    splitters.register(spark)
    _texts(spark, sf, "documents").createOrReplaceTempView("texts_to_split")
    return spark.sql(
        "SELECT doc_id, CAST(n AS BIGINT) AS n, c.content, c.level, array_join(c.path, ' > ') AS path, array_join(c.types, ',') AS types "
        "FROM (SELECT doc_id, posexplode(split_text(text)) AS (n, c) FROM texts_to_split)"
    )


def parse_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    """Every third text is none; it takes the default."""
    e = load(spark, sf, "events").withColumn("said", F.when(F.col("event_id") % 3 == 0, F.lit("soon")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    return e.select("event_id", text.timestamp_or(F.col("said"), F.lit("2000-01-01 00:00:00").cast("timestamp")).cast("timestamp_ntz").alias("at"))


def links_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = html.links_column(F.col("html"), F.lit(""))  # without a base, references stay as they are
    return _texts(spark, sf, "pages").select("page_id", F.posexplode(found).alias("pos", "link")).select("page_id", F.col("pos").cast("long").alias("pos"), F.col("link.url").alias("href"))


def links_skip(spark: SparkSession, sf: str) -> DataFrame:
    extra = F.array(*[F.lit(x) for x in ("#section", "javascript:void(0)", "mailto:a@b.c", "tel:1", "data:x", "  ", " valid ")])
    p = _texts(spark, sf, "pages").select("page_id", F.explode(F.concat(html.hrefs_expr(F.col("html")), extra)).alias("href"))
    return p.groupBy("page_id").agg(F.count(F.when(~urls.leads_nowhere(F.col("href")), 1)).alias("kept"), F.count(F.when(urls.leads_nowhere(F.col("href")), 1)).alias("skipped"))


def crawl_filter(spark: SparkSession, sf: str) -> DataFrame:
    ok = urls.wanted(F.col("url"), urls.host(F.lit("https://ththre.example.com/")), [r"/(fr|en)/", "("], [r"\?page="])
    return _texts(spark, sf, "pages").select("page_id", ok.alias("wanted"))


def filter_links(spark: SparkSession, sf: str) -> DataFrame:
    kept = urls.filter_links(html.hrefs_expr(F.col("html")), ["^/[a-m]", "e$"], ["^/the"])
    return _texts(spark, sf, "pages").select("page_id", F.size(kept).cast("long").alias("n"), F.array_join(kept, " ").alias("links"))


def crawl_frontier(spark: SparkSession, sf: str) -> DataFrame:
    p = _texts(spark, sf, "pages")
    links = p.select(F.explode(html.hrefs_expr(F.col("html"))).alias("href"), "url").select(urls.resolve_rooted(F.col("url"), F.col("href")).alias("url"))
    visited = links.filter(F.length("url") % 3 == 0).unionByName(p.select("url"))
    return crawl.frontier(links, visited)


def extract_title(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf, "pages").select("page_id", html.title_column(F.col("html")).alias("title"))


def extract_description(spark: SparkSession, sf: str) -> DataFrame:
    """What pages say of themselves; a page without such a tag gives an empty text."""
    return _texts(spark, sf, "pages").select("page_id", html.description_expr(F.col("html")).alias("description"))


def html_to_markdown(spark: SparkSession, sf: str) -> DataFrame:
    p = _texts(spark, sf, "pages").select("page_id", html.markdown_column(F.col("html")).alias("p"))
    return p.select("page_id", "p.title", "p.content", "p.excerpt")


def main_text(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf, "pages").select("page_id", html.main_text_column(F.col("html")).alias("text"))


def process_pages(spark: SparkSession, sf: str) -> DataFrame:
    return crawl.process(_texts(spark, sf, "pages")).select("page_id", "url", "title", "content", F.size("links").cast("long").alias("n_links"))


def crawl_bfs(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.createDataFrame(SITE, "url string, html string")
    return crawl.crawl(pages, "https://s.test/", crawl.CrawlOptions(max_depth=2)).select("url", "depth", "title", "content")


def _split(df: DataFrame, key: str, column, split, **options) -> DataFrame:
    chunks = splitters.chunks(column, split, **options)
    return df.select(key, F.posexplode(chunks).alias("n", "c")).select(key, F.col("n").cast("long").alias("n"), "c.content", "c.level", F.array_join("c.path", " > ").alias("path"), F.array_join("c.types", ",").alias("types"))


def split_markdown(spark: SparkSession, sf: str) -> DataFrame:
    p = _texts(spark, sf, "pages").select("page_id", html.markdown_column(F.col("html"))["content"].alias("md"))
    return _split(p, "page_id", F.col("md"), splitters.split_markdown)


def split_text(spark: SparkSession, sf: str) -> DataFrame:
    return _split(_texts(spark, sf, "documents"), "doc_id", F.col("text"), splitters.split_text)


def split_separators(spark: SparkSession, sf: str) -> DataFrame:
    return _split(_texts(spark, sf, "documents"), "doc_id", F.col("text"), splitters.split_separators)


def split_code(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame(CODE, "language string, code string")
    parts = [_split(rows.filter(F.col("language") == name), "language", F.col("code"), splitters.split_code, language=name) for name, _ in CODE]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split_code_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _split(_texts(spark, sf, "documents"), "doc_id", F.col("text"), splitters.split_code, language="go")


def split_fixed_window(spark: SparkSession, sf: str) -> DataFrame:
    n = F.greatest(F.ceil((F.length("text") - 200) / 1300), F.lit(1))
    d = _texts(spark, sf, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("n"))
    piece = F.substring(F.col("text"), F.col("n").cast("int") * 1300 + 1, F.lit(1500))
    return d.select("doc_id", F.col("n").cast("long").alias("n"), F.length(piece).cast("long").alias("chars"), F.md5(piece).alias("md5"))


def embed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = _split(_texts(spark, sf, "documents"), "doc_id", F.col("text"), splitters.split_text)
    return embedding.embed(chunks, embedding.create("hash:hash-64")).select("doc_id", "n", F.size("embedding").cast("long").alias("dim"))


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_")}

_CJK = r"[\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}]"
_EST = f"(greatest(1, (length(text) - length(regexp_replace(text, '{_CJK}', '', 'g'))) + greatest(1, length(regexp_replace(text, '{_CJK}', '', 'g')) // 4)) + 5)::BIGINT"
_HREFS = """regexp_extract_all(html, '<a href="([^"]*)"', 1)"""
_HOST = "lower(regexp_extract({}, '://([^/?#:]*)', 1))"
_ORIGIN = "regexp_extract(url, '^[a-z]+://[^/?#]+')"
_TARGET = f"CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN {_ORIGIN} || href ELSE href END"
_TITLE = r"regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '^\s+|\s+$', '', 'g')"
_NOWHERE = r"(regexp_replace(href, '^\s+|\s+$', '', 'g') = '' OR regexp_matches(regexp_replace(href, '^\s+|\s+$', '', 'g'), '^(#|javascript:|mailto:|tel:|data:)'))"
_MD = "string_split(" + " || chr(10) || ".join(f"'{x}'" for x in MARKDOWN.split("\n")) + ", chr(10))"
_LINES = f"l AS (SELECT unnest(range(len({_MD}))) AS n, unnest({_MD}) AS line), h AS (SELECT n::BIGINT AS n, length(regexp_extract(line, '^(#{{1,6}})([^#].*)?$', 1))::BIGINT AS level, regexp_replace(regexp_extract(line, '^#{{1,6}}([^#].*)?$', 1), '^\\s+|\\s+$', '', 'g') AS title FROM l)"

SQL = markup_sql.texts(SITE, CODE) | {
    "estimate_tokens": f"SELECT doc_id, {_EST} AS tokens FROM documents",
    "batch_tokens": f"SELECT source, sum({_EST})::BIGINT AS tokens FROM documents GROUP BY source",
    "text_lengths": r"SELECT doc_id, length(text)::BIGINT AS chars, strlen(text)::BIGINT AS bytes, length(regexp_replace(text, '^\s+|\s+$', '', 'g'))::BIGINT AS trimmed, md5(lower(text)) AS lower FROM documents",
    "preview": """SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS p200,
      replace(replace(replace(CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS p300 FROM documents""",
    "newline_collapse": r"SELECT doc_id, regexp_replace(regexp_replace(chr(10) || chr(10) || replace(text, chr(10), repeat(chr(10), 5)) || chr(10), '\n{4,}', repeat(chr(10), 3), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents",
    "atx_headers": f"WITH {_LINES} SELECT n, level, title FROM h",
    "heading_path": f"""WITH {_LINES}, a AS (
      SELECT n, last_value(CASE WHEN level = 1 THEN n END IGNORE NULLS) OVER w AS a1, last_value(CASE WHEN level = 2 THEN n END IGNORE NULLS) OVER w AS a2, last_value(CASE WHEN level = 3 THEN n END IGNORE NULLS) OVER w AS a3,
        last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER w AS t1, last_value(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER w AS t2, last_value(CASE WHEN level = 3 THEN title END IGNORE NULLS) OVER w AS t3
      FROM h WINDOW w AS (ORDER BY n))
      SELECT n, concat_ws(' > ', t1, CASE WHEN a2 > coalesce(a1, -1) THEN t2 END, CASE WHEN a3 > greatest(coalesce(a1, -1), coalesce(a2, -1)) THEN t3 END) AS path FROM a""",
    "brace_balance": """SELECT page_id, sum(length(html) - length(replace(html, '{', '')) - (length(html) - length(replace(html, '}', ''))) + 1)
      OVER (PARTITION BY regexp_extract(url, '://([^/]*)', 1) ORDER BY page_id ROWS UNBOUNDED PRECEDING)::BIGINT AS balance FROM pages""",
    "json_path": "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '[]') AS k, coalesce(json_extract_string(props, '$.path'), '[]') AS path FROM events",
    "parse_model_spec": """SELECT * FROM (VALUES ('OpenAI:text-embedding-3-large', 'openai', 'text-embedding-3-large'), ('google', 'google', 'text-embedding-004'), ('openai', 'openai', 'text-embedding-3-small'),
      ('text-embedding-004', 'openai', 'text-embedding-004'), ('google:embedding-001', 'google', 'embedding-001')) t(spec, provider, model)""",
    "url_resolve_rooted": f"SELECT page_id, pos::BIGINT AS pos, {_TARGET} AS target FROM (SELECT page_id, url, unnest(range(len({_HREFS}))) AS pos, unnest({_HREFS}) AS href FROM pages)",
    "extract_links": f"""WITH l AS (SELECT page_id, url, href, pos FROM (SELECT page_id, url, unnest(range(len({_HREFS}))) AS pos, unnest({_HREFS}) AS href FROM pages)),
      t AS (SELECT page_id, url, {_TARGET} AS target, min(pos) AS pos FROM l WHERE NOT {_NOWHERE} GROUP BY page_id, url, target),
      g AS (SELECT page_id, count(*) AS n, count(*) FILTER ({_HOST.format('target')} = {_HOST.format('url')}) AS own, arg_min(target, pos) AS f FROM t GROUP BY page_id)
      SELECT page_id, coalesce(n, 0)::BIGINT AS links, coalesce(own, 0)::BIGINT AS internal, f AS first FROM pages LEFT JOIN g USING (page_id)""",
    "extract_links_fewer_skips": f"""WITH l AS (SELECT page_id, {_TARGET} AS target FROM (SELECT page_id, url, unnest({_HREFS}) AS href FROM pages) WHERE NOT {_NOWHERE})
      SELECT page_id, (coalesce(n, 0) + 2)::BIGINT AS links, 'tel:1' AS last FROM pages LEFT JOIN (SELECT page_id, count(DISTINCT target) AS n FROM l GROUP BY page_id) USING (page_id)""",
    "parse_timestamps": "SELECT event_id, coalesce(try_cast(CASE WHEN event_id % 3 = 0 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP), TIMESTAMP '2000-01-01 00:00:00') AS at FROM events",
    "links_dedup": f"""WITH l AS (SELECT page_id, href, min(pos) AS p FROM (SELECT page_id, unnest(range(len({_HREFS}))) AS pos, unnest({_HREFS}) AS href FROM pages) GROUP BY page_id, href)
      SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY p) - 1)::BIGINT AS pos, href FROM l""",
    "links_skip": f"""SELECT page_id, count(*) FILTER (NOT {_NOWHERE})::BIGINT AS kept, count(*) FILTER ({_NOWHERE})::BIGINT AS skipped
      FROM (SELECT page_id, unnest(list_concat({_HREFS}, ['#section', 'javascript:void(0)', 'mailto:a@b.c', 'tel:1', 'data:x', '  ', ' valid '])) AS href FROM pages) GROUP BY page_id""",
    "crawl_filter": r"SELECT page_id, (lower(regexp_extract(url, '://([^/?#:]*)', 1)) IN ('ththre.example.com', '')) AND NOT regexp_matches(url, '\?page=') AND regexp_matches(url, '/(fr|en)/') AS wanted FROM pages",
    "filter_links": f"""SELECT page_id, len(k)::BIGINT AS n, array_to_string(k, ' ') AS links FROM (SELECT page_id, list_filter({_HREFS}, lambda u: NOT regexp_matches(u, '^/the') AND regexp_matches(u, '(?:^/[a-m])|(?:e$)')) AS k FROM pages)""",
    "crawl_frontier": f"""WITH l AS (SELECT {_TARGET} AS u FROM (SELECT url, unnest({_HREFS}) AS href FROM pages))
      SELECT DISTINCT u AS url FROM l WHERE u NOT IN (SELECT u FROM l WHERE length(u) % 3 = 0) AND u NOT IN (SELECT url FROM pages)""",
    "extract_title": f"""SELECT page_id, replace(replace(replace(replace(replace({_TITLE}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS title FROM pages""",
    "extract_description": """SELECT page_id, regexp_extract(html, '(?is)<meta name="description" content="([^"]*)"', 1) AS description FROM pages""",
    "split_fixed_window": """WITH w AS (SELECT doc_id, text, unnest(range(greatest(ceil((length(text) - 200) / 1300.0), 1)::BIGINT)) AS n FROM documents)
      SELECT doc_id, n, length(substr(text, n * 1300 + 1, 1500))::BIGINT AS chars, md5(substr(text, n * 1300 + 1, 1500)) AS md5 FROM w""",
}
