"""Line dedup against counting in Python."""

from pyspark.sql import functions as F

from siltstone.llm import lines

SCHEMA = "doc_id long, text string, source string, lines string, site string, n_lines long"


def brute(rows, ratio=lines.RATIO, least=lines.MIN_PAGES, counted=None):
    ws = " \t\n\v\f\r"
    pages, seen = {}, {}
    for _, text, site in counted or rows:
        pages[site] = pages.get(site, 0) + 1
        for line in {x.strip(ws) for x in (text or "").split("\n")} - {""}:
            seen[site, line] = seen.get((site, line), 0) + 1
    out = []
    for i, text, site in rows:
        if text is None:
            out.append((i, site, None, 0, 0))
            continue
        all_ = text.split("\n")
        kept = [x for x in all_ if pages.get(site, 0) < least or not x.strip(ws) or seen.get((site, x.strip(ws)), 0) <= ratio * pages[site]]
        out.append((i, site, "\n".join(kept), len(all_), len(all_) - len(kept)))
    return out


ROWS = [(i, f"menu\nbody {i}\n  menu \n\nfooter {i % 2}\n\n", "a") for i in range(10)]
ROWS += [(i, f"menu\nonly {i}", "small") for i in range(20, 24)]
ROWS += [(30, None, "a"), (31, "", "a"), (32, "menu", None), (33, "menu\r\nx", None), (34, "y", None), (35, "y", None), (36, "menu\t", None), (36, "menu\t", None)]
ROWS += [(40, "\n".join(f"long {k}" for k in range(30000)), "a")]


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash", 7) for r in rows], SCHEMA)
    return lines.drop_boilerplate(df, F.col("source"), F.col("text"), F.col("doc_id"))


def test_against_brute_force(spark):
    key = lambda r: (r[0], str(r[2]))
    assert sorted(map(tuple, run(spark, ROWS).collect()), key=key) == sorted(brute(ROWS), key=key)


def test_empty_table(spark):
    assert run(spark, []).count() == 0


def test_html_lines(spark):
    html = "<html><head><title>T</title><style>p{}</style><script>var a='<p>';</script></head><body><ul><li>one</li><li><b>t</b>wo</li></ul><!-- no --><p> x<br>y</p></body></html>"
    unclosed = ["a<p>b<script>c<p>d", "a<!-- b<p>c", "a <p <b>c</b>"]
    got = spark.createDataFrame([(x,) for x in (html, None, "", *unclosed)], "html string").select(lines.html_lines(F.col("html"))).collect()
    assert [r[0] for r in got] == ["T\none\ntwo\nx\ny", None, "", "a\nb", "a", "a <p c"]


def test_unclosed_tags_are_read_once(spark):
    n = 300_000
    texts = ["<script" * n, "<!--" * n, "<p " * n, "<a " * n, "<" * n]
    got = spark.createDataFrame([(x,) for x in texts], "html string").select(F.length(lines.html_lines(F.col("html")))).collect()
    assert len(got) == len(texts)
