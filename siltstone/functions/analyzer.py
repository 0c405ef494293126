"""The stemmed analyzer of full-text search: accents off, lower case, Porter's algorithm."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


class _Stem:
    """Porter (1980), over words of ASCII letters."""

    def __init__(self, word: str):
        self.w = word

    def consonant(self, i: int) -> bool:
        c = self.w[i]
        return c not in "aeiou" and (c != "y" or i == 0 or not self.consonant(i - 1))

    def measure(self, n: int) -> int:
        """Vowel-consonant sequences in the first n letters."""
        kinds = [self.consonant(i) for i in range(n)]
        return sum(1 for a, b in zip(kinds, kinds[1:], strict=False) if not a and b)

    def vowel(self, n: int) -> bool:
        return any(not self.consonant(i) for i in range(n))

    def doubled(self) -> bool:
        return len(self.w) > 1 and self.w[-1] == self.w[-2] and self.consonant(len(self.w) - 1)

    def short(self, n: int) -> bool:
        return n > 2 and self.consonant(n - 1) and not self.consonant(n - 2) and self.consonant(n - 3) and self.w[n - 1] not in "wxy"

    def swap(self, rules, least: int) -> None:
        """The first rule whose ending fits applies, if what stays measures over ``least``."""
        for old, new in rules:
            if self.w.endswith(old):
                if self.measure(len(self.w) - len(old)) > least:
                    self.w = self.w[: len(self.w) - len(old)] + new
                return


#: The published algorithm's endings.
_TWO = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("logi", "log"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_THREE = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_FOUR = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def porter(word: str) -> str:
    """The stem of a lower-case word; words under three letters or with other characters stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    s = _Stem(word)
    if s.w.endswith("sses") or s.w.endswith("ies"):
        s.w = s.w[:-2]
    elif s.w.endswith("s") and not s.w.endswith("ss"):
        s.w = s.w[:-1]
    if s.w.endswith("eed"):
        if s.measure(len(s.w) - 3) > 0:
            s.w = s.w[:-1]
    else:
        for end in ("ed", "ing"):
            if s.w.endswith(end) and s.vowel(len(s.w) - len(end)):
                s.w = s.w[: -len(end)]
                if s.w.endswith(("at", "bl", "iz")):
                    s.w += "e"
                elif s.doubled() and s.w[-1] not in "lsz":
                    s.w = s.w[:-1]
                elif s.measure(len(s.w)) == 1 and s.short(len(s.w)):
                    s.w += "e"
                break
    if s.w.endswith("y") and s.vowel(len(s.w) - 1):
        s.w = s.w[:-1] + "i"
    s.swap(_TWO, 0)
    s.swap(_THREE, 0)
    for end in sorted(_FOUR, key=len, reverse=True):
        if s.w.endswith(end):
            n = len(s.w) - len(end)
            if s.measure(n) > 1 and (end != "ion" or s.w[n - 1] in "st"):
                s.w = s.w[:n]
            break
    if s.w.endswith("e"):
        n = len(s.w) - 1
        m = s.measure(n)
        if m > 1 or m == 1 and not s.short(n):
            s.w = s.w[:-1]
    if s.w.endswith("ll") and s.measure(len(s.w)) > 1:
        s.w = s.w[:-1]
    return s.w


def analyze(text: str | None) -> list[str]:
    """Stemmed tokens of a text, in order."""
    return [porter(w) for w in _WORD.findall(fold(text or ""))]


def stemmed_tokens(s: Column) -> Column:
    @F.pandas_udf("array<string>")
    def stemmed(texts: pd.Series) -> pd.Series:
        return texts.map(analyze)

    return stemmed.asNondeterministic()(s)  # so that no filter repeats it
