"""Suffix-array repeats and counts against quadratic Python."""

import random
import re

import numpy as np
import pytest

from siltstone.llm import repetition

SCHEMA = "doc_id long, text string, n_words string, keep string, kept boolean"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def longest_repeats(words, window):
    n, out = len(words), []
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best if best >= window else 0)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_suffix_array(seed):
    rng = random.Random(seed)
    docs = [[rng.randrange(rng.choice([1, 2, 3, 20])) for _ in range(rng.randrange(0, 60))] for _ in range(4)]
    docs[0] = docs[0] * rng.randrange(1, 4)
    window = rng.choice([2, 3, 4, 8])
    ends = np.cumsum([len(d) for d in docs])
    got = repetition.suffix_repeats(np.array([w for d in docs for w in d], dtype=np.int64), ends, window)
    assert got.tolist() == [x for d in docs for x in longest_repeats(d, window)]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    reps = longest_repeats(words, 8)
    inside = {k for i, n in enumerate(reps) for k in range(i, i + n)}
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    base = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 8)}
    assert inside == base
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    chars = sum(map(len, words))
    failed = len(words) < 20 or 100 * len(base) > 30 * len(words)
    short = {k for i, n in enumerate(longest_repeats(words, 3)) for k in range(i, i + n)}
    kept = not (failed or sum(len(words[i]) for i in short) > 0.2 * chars or max(reps, default=0) > 0.08 * len(words))
    return (len(words), chars, sum(c in "#*$%&|<>" for c in text), dup, len(base), failed, kept)


def test_against_brute_force(spark, sf):
    texts = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars < 3000").select("text").limit(60).collect()]
    phrase = " ".join(f"w{k}" for k in range(12))
    texts += [None, "", " \n\t", "a\u00a0b \u2003c\x1cd", "x " * 300, "\n".join(["same line here", "other", "same line here", "", ""] * 3)]
    texts += [f"{phrase} " + " ".join(f"u{k}" for k in range(100)) + f" {phrase}", "é# " * 25, " ".join(f"v{k}" for k in range(55)) * 2]
    rows = [(i, t, "clash", "clash", None) for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[0], "", "", True)]
    got = repetition.quality(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(texts[r["doc_id"] or 0])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"], r["kept"]) == want
    assert repetition.quality(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_long_repeat_is_measured():
    passage = " ".join(f"p{k}" for k in range(60))
    text = passage + " " + " ".join(f"u{k}" for k in range(100)) + " " + passage
    m = repetition.measure([text])
    assert m["longest_repeat"].tolist() == [60] and m["n_repeat_words"].tolist() == [120]


def test_very_long_text():
    m = repetition.measure(["a b c d e f g h i j " * 60000])
    assert m["n_repeat_words"][0] == 600000 and m["longest_repeat"][0] == 600000 - 10


def test_only_the_method_rejects(spark):
    """Repeats shorter than a window, and long passages below the base limit."""
    lines = "\n".join(f"one two three four five six seven new{k}" for k in range(40))
    passage = " ".join(f"p{k}" for k in range(140))
    rest = " ".join(f"u{k}" for k in range(720))
    less = " ".join(f"p{k}" for k in range(90))
    texts = [lines, f"{passage} {rest} {passage}", f"{less} {rest} ab cd {less}", rest]
    assert [brute(t)[-2:] for t in texts] == [(False, False)] * 3 + [(False, True)]
    got = repetition.quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["base_failed"], r["kept"]) for r in got] == [(False, False)] * 3 + [(False, True)]
    assert got[0]["n_repeat_words"] == 0
