"""URL filters: rules, and PageRank over host links from ruled hosts. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): a configuration, so it becomes one CASE expression.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DAMPING, ROUNDS, RATIO = 0.85, 20, 1.0
#: Hosts up to which the table of host scores is broadcast.
BROADCAST_HOSTS = 100_000


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls; of equally long ones the last in code point order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(source, target, n): links of pages from one host to another. A tag ends at the next < at the latest."""
    hrefs = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)<a\s(?:[^<>]*?\s)?href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]*)"""), F.lit(1))
    links = pages.select(host_of(F.col(url_col)).alias("source"), F.explode(hrefs).alias("href"))
    target = host_of(F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), F.col("href"))).otherwise(F.col("href")))
    return (
        links.select("source", target.alias("target"))
        .filter("source != '' and target != '' and source != target")
        .groupBy("source", "target")
        .agg(F.count("*").alias("n"))
    )


def host_scores(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    damping: float = DAMPING,
    rounds: int = ROUNDS,
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """(host, trust, distrust) of every host that has pages or is linked to.

    Trust starts at hosts by their share of allowed pages and follows links;
    distrust starts by their share of blocked pages and follows links backwards,
    to those who link to bad hosts. Both run in one table, a row for each host
    and kind, in ``rounds`` power iterations of

        rank = seed + damping * (what flows in, by each linking host's share of its links).

    That is personalised PageRank up to one factor a kind: its usual (1 -
    damping) is left out, and returning the rank of hosts without onward links
    to the seeds would multiply all ranks of a kind by the same number. So a
    host without links keeps its seed, whatever other hosts link to. Each round
    joins on the host and sums per target with partial sums before the shuffle,
    and is written, so that plans stay short. Without any link no round is run,
    as each would return the seeds.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    verdict = rule_of(host, path, rules)[1]
    ruled = pages.select(host.alias("host"), verdict.alias("verdict"))
    counts = ruled.groupBy("host").agg(
        F.count(F.when(F.col("verdict") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("verdict") == "block", 1)).alias("blocked")
    )
    links = Written(host_links(pages, url_col, html_col), "hosts-links")
    linked = links.df.select(F.col("target").alias("host"), F.lit(0).cast("long").alias("allowed"), F.lit(0).cast("long").alias("blocked")).distinct()
    counts = Written(counts.unionByName(linked).groupBy("host").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")), "hosts-seeds").df
    all_of = counts.agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")).first()
    share = lambda x: F.col(x) / F.lit(float(all_of[x] or 1))
    both = counts.select("host", F.explode(F.create_map(F.lit("trust"), share("allowed"), F.lit("distrust"), share("blocked"))).alias("kind", "seed"))
    seeds = Written(both, "hosts-both")
    rank = seeds.df.select("host", "kind", F.col("seed").alias("rank"))
    if links.df.limit(1).count():
        n = links.df
        forth = n.join(n.groupBy("source").agg(F.sum("n").alias("all")), "source").select(
            F.col("source").alias("host"), F.lit("trust").alias("kind"), F.col("target").alias("to"), (F.col("n") / F.col("all")).alias("part")
        )
        back = n.join(n.groupBy("target").agg(F.sum("n").alias("all")), "target").select(
            F.col("target").alias("host"), F.lit("distrust").alias("kind"), F.col("source").alias("to"), (F.col("n") / F.col("all")).alias("part")
        )
        edges = Written(forth.unionByName(back), "hosts-edges").df
        before = None
        for _ in range(rounds):
            flow = edges.join(rank, ["host", "kind"]).groupBy(F.col("to").alias("host"), "kind").agg(F.sum(F.col("rank") * F.col("part")).alias("flow"))
            after = seeds.df.join(flow, ["host", "kind"], "left").select(
                "host", "kind", (F.col("seed") + damping * F.coalesce("flow", F.lit(0.0))).alias("rank")
            )
            written = Written(after, "hosts-rank")
            if before:
                before.drop()
            before, rank = written, written.df
    of = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    return rank.groupBy("host").agg(of("trust"), of("distrust"))


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    ratio: float = RATIO,
    id_col: str = "page_id",
    url_col: str = "url",
    **settings,
) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) for every row of ``pages``.

    Where a rule fits, its verdict holds; elsewhere a host is blocked if its
    distrust exceeds ``ratio`` times its trust. A null URL, or one without
    ://, has an empty host and path, fits no rule and is allowed unless seeds
    say otherwise (an empty host has none). Repeated rows get equal verdicts
    (and count as often as seeds); null and empty html has no links, html of
    any length is searched whole; equal trust and distrust do not block; an
    empty table gives no rows; columns of other names are not read.
    """
    scores = small(Written(host_scores(pages, rules, url_col=url_col, **settings), "hosts-scores").df, BROADCAST_HOSTS)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    spread = F.when(F.col("distrust") > F.lit(ratio) * F.col("trust"), "block").otherwise("allow")
    return rows.join(scores, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, spread).alias("verdict"), "trust", "distrust"
    )
