"""Splitters: the assertions of FIXTURES.md and properties."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.functions import splitters as sp


def test_header_only_sections_join_the_next():
    got = sp.split_markdown("# Main Title\n\n## Empty Section 1\n\n## Empty Section 2\n\n### Actual Content\n\nThis is real content.\n\n## Another Section\n\nMore content here.")
    assert all(len(c.content) > 20 for c in got)
    assert "Empty Section" in next(c.content for c in got if "real content" in c.content)


def test_paths_levels_and_intro():
    got = sp.split_markdown("before\n\n# Level 1\n## Level 2\n### Level 3\ntext")
    assert [(c.level, c.path) for c in got] == [(0, []), (3, ["Level 1", "Level 2", "Level 3"])]
    assert got[0].content == "before" and "# Level 1" in got[1].content
    assert sp.split_markdown("") == [] and sp.split_markdown(None) == []


def test_siblings_leave_the_path_and_fences_hide_hashes():
    got = sp.split_markdown("# A\na\n## B\nb\n### C\nc\n## D\nd\n```\n# not a heading\n```\n# E\ne")
    assert [c.path for c in got] == [["A"], ["A", "B"], ["A", "B", "C"], ["A", "D"], ["E"]]
    assert "# not a heading" in got[3].content


def test_trailing_headings_are_kept():
    assert sp.split_markdown("# A\ntext\n## End")[0].content.endswith("## End")
    assert [c.content for c in sp.split_markdown("# Only")] == ["# Only"]


def covers(text: str, parts: list[str]) -> bool:
    at = 0
    for p in parts:
        i = text.find(p)
        while i != -1 and i > at:
            return False
        while (j := text.find(p, i + 1)) != -1 and j <= at:
            i = j
        at = max(at, i + len(p))
    return at >= len(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é世\n", max_size=400), st.integers(20, 80), st.integers(0, 15))
def test_windows_lose_nothing(text, limit, overlap):
    parts = sp.windows(text, limit, overlap, 10, (b"\n\n", b"\n"))
    assert all(sp.size(p) <= limit + 10 + 3 for p in parts)
    rebuilt = ""
    for p in parts:
        k = next((n for n in range(min(len(p), len(rebuilt)), -1, -1) if rebuilt.endswith(p[:n])), 0)
        rebuilt += p[k:]
    assert len(rebuilt) <= len(text) and ("".join(parts) != "") == (text != "")
    assert sum(map(len, parts)) >= len(text)


def test_a_long_line_is_covered():
    text = "".join(chr(97 + i % 26) + str(i) for i in range(900))
    parts = [c.content for c in sp.split_markdown("## X\n\n" + text)]
    assert covers("## X\n\n" + text, parts)


@pytest.mark.parametrize(("at", "want"), [(0, 0), (5, 5), (6, 8), (7, 8), (8, 8), (100, 13)])
def test_boundary(at, want):
    assert sp.boundary("Hello…World".encode(), at) == want


def test_text():
    got = sp.split_text("This is a test. " * 100)
    assert got and all(sp.size(c.content) <= 1600 for c in got)
    assert sp.split_text("") == [] and [c.content for c in sp.split_text("This is a small text.")] == ["This is a small text."]
    assert sp.split_text("é" * 4000)


def test_separators():
    assert [c.content for c in sp.split_separators("Paragraph 1.\n\nParagraph 2.\n\nParagraph 3.", limit=20)] == ["Paragraph 1.", "Paragraph 2.", "Paragraph 3."]
    assert len(sp.split_separators("x" * 4000)) == 3  # terminates


def test_code():
    rust = sp.split_code('fn main() {\n    println!("x");\n}\n\nstruct Point {\n    x: i32,\n}\n\nimpl Point {\n    fn new() {}\n}\n', "rust")
    assert [c.path[0] for c in rust] == ["main", "Point", "Point"] and rust[0].types == ["code", "rust"]
    python = sp.split_code("import os\n\ndef hello():\n    pass\n\nclass Person:\n    def name(self):\n        pass\n", "py")
    assert [c.path[0] for c in python] == ["module", "hello", "Person"]
    assert sp.split_code("func (p *P) Get() int {\n\treturn 1\n}", "go")[0].level == 2
    assert sp.split_code("", "rust") == []
    assert all(sp.size(c.content) <= 1500 for c in sp.split_code("fn f() {\n" + "  x();\n" * 900 + "}\n", "rust"))


#: A batch of some 7 MB, whose rows say nothing of its size.
BATCH = pa.array(["word " * 200 + "end"] * 4000 + [None, "", "x" * 3_000_000, "é\n" * 1000])


def portions_of(split) -> int:
    """Splits ``BATCH`` as a column does and compares the chunks; the texts that were split when the first left."""
    done = []
    out = sp.splitter(lambda t: done.append(t) or split(t)).func(iter([BATCH]))
    got, first = next(out).to_pylist(), len(done)
    got += [x for part in out for x in part.to_pylist()]
    assert got == [[vars(c) for c in split(t)] for t in BATCH.to_pylist()]
    return first


def test_chunks_of_a_batch_leave_in_portions(spark):
    assert portions_of(sp.split_text) <= 1100
    sp.register(spark)
    spark.createDataFrame([(1, "a b " * 500_000), (2, None), (3, "c"), (4, "")], "id int, text string").coalesce(1).createOrReplaceTempView("t")
    got = spark.sql("SELECT id, n, c.content FROM (SELECT id, posexplode(split_text(text)) AS (n, c) FROM t)").collect()
    assert sorted(got)[:-1] == [(1, n, c.content) for n, c in enumerate(sp.split_text("a b " * 500_000))] and sorted(got)[-1] == (3, 0, "c")


def test_lines_of_a_batch_leave_in_portions():
    assert portions_of(lambda t: sp.split_code(t, "go")) <= 1100
