"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Beginnings of references that lead to no page.
SKIP = r"^(#|javascript:|mailto:|tel:|data:)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]+", 0)


def leads_nowhere(href: Column) -> Column:
    bare = F.regexp_replace(href, r"^\s+|\s+$", "")
    return (bare == "") | bare.rlike(SKIP)


def resolve_rooted(base: Column, href: Column) -> Column:
    """Absolute http(s) references as they are, rooted ones on the base's origin, others unchanged."""
    return F.when(href.rlike("^https?://"), href).when(href.startswith("/"), F.concat(origin(base), href)).otherwise(href)


def valid_patterns(patterns: list[str]) -> list[str]:
    """Patterns that compile; others are dropped. The JVM decides, which will run them."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("patterns are checked by the JVM of an active session")
    compile_ = spark.sparkContext._jvm.java.util.regex.Pattern.compile
    out = []
    for p in patterns:
        try:
            compile_(p)
        except IllegalArgumentException:
            continue
        out.append(p)
    return out


def wanted(url: Column, base_host: Column | str, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """On the base's host (unparseable URLs pass), matching no exclusion and, if any is given, an inclusion."""
    of = F.lit(base_host) if isinstance(base_host, str) else base_host
    ok = (host(url) == of) | (host(url) == "")
    for p in valid_patterns(list(exclude)):
        ok = ok & ~url.rlike(p)
    if kept := valid_patterns(list(include)):
        any_of = F.lit(False)
        for p in kept:
            any_of = any_of | url.rlike(p)
        ok = ok & any_of
    return ok


def filter_links(links: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """An array of URLs without excluded ones and, if any pattern is given, with included ones only."""
    if gone := valid_patterns(list(exclude)):
        links = F.filter(links, lambda u: ~u.rlike("|".join(f"(?:{p})" for p in gone)))
    if kept := valid_patterns(list(include)):
        links = F.filter(links, lambda u: u.rlike("|".join(f"(?:{p})" for p in kept)))
    return links
