"""Text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges counted as CJK by the token estimate.
CJK = r"[\x{4e00}-\x{9fff}\x{3040}-\x{309f}\x{30a0}-\x{30ff}\x{ac00}-\x{d7af}]"
#: Characters with a meaning in full-text queries.
QUERY_MARKS = "\"'()*^"


def trim_all(s: Column) -> Column:
    """Without white space at either end (``trim`` takes spaces only)."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def byte_length(s: Column) -> Column:
    return F.octet_length(s).cast("long")


def char_length(s: Column) -> Column:
    return F.char_length(s).cast("long")


def preview(s: Column, n: int = 200) -> Column:
    """The first ``n`` characters, with dots if there are more."""
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


def collapse_newlines(s: Column) -> Column:
    """Runs of four or more newlines become three; white space at the ends goes."""
    return trim_all(F.regexp_replace(s, "\n{4,}", "\n\n\n"))


def estimate_tokens(s: Column) -> Column:
    """One per CJK character, one per four others, one at least of each sum, and five for the message."""
    chars = F.char_length(s)
    cjk = chars - F.char_length(F.regexp_replace(s, CJK, ""))
    others = F.greatest(F.lit(1), F.floor((chars - cjk) / 4))
    return (F.greatest(F.lit(1), cjk + others) + 5).cast("long")


def clean_query(s: Column) -> Column:
    """Words of a query joined by OR, without characters that full-text syntax gives a meaning."""
    words = F.split(F.translate(s, QUERY_MARKS, " " * len(QUERY_MARKS)), r"\s+")
    return F.array_join(F.filter(words, lambda w: w != ""), " OR ")


def lines(s: Column) -> Column:
    """Lines, without the empty one that follows a last newline."""
    parts = F.split(s, r"\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def heading_level(line: Column) -> Column:
    """1 to 6 for a line that begins with so many hashes, else 0."""
    return F.length(F.regexp_extract(line, r"^(#{1,6})([^#].*)?$", 1)).cast("long")


def heading_title(line: Column) -> Column:
    return trim_all(F.regexp_extract(line, r"^#{1,6}([^#].*)?$", 1))


def percent(share: Column) -> Column:
    """A share as a percentage with one place."""
    return F.format_string("%.1f%%", share * 100)


def timestamp_or(value: Column, default: Column) -> Column:
    """A text as a timestamp, ``default`` where it is none."""
    return F.coalesce(F.try_to_timestamp(value), default)


def count_of(s: Column, mark: str) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(mark), F.lit("")))).cast("long")


def escape_html(s: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(mark), F.lit(name))
    return s


def tokens(s: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def progress(n: Column, max_pages: int) -> list[Column]:
    """Estimates after ``n`` pages: queue length, pages discovered, total, phase."""
    queue = F.when(n < 5, F.greatest(F.lit(3), n * 2)).otherwise(F.greatest(F.lit(1), F.floor(n / 3))).cast("long")
    discovered = (n + queue).cast("long")
    total = F.greatest(F.least(discovered, F.lit(max_pages)), F.lit(1)).cast("long")
    return [
        queue.alias("queue_length"),
        discovered.alias("discovered"),
        total.alias("total_pages"),
        F.when(n < 3, "discovering").otherwise("scraping").alias("phase"),
    ]
