"""Splitters: one text to many chunks. Sizes are bytes of UTF-8; cuts fall between characters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SIZE, OVERLAP, SLACK = 1500, 200, 200
CHUNK = "array<struct<content:string,level:int,path:array<string>,types:array<string>>>"
CHUNKS = pa.list_(pa.struct({"content": pa.string(), "level": pa.int32(), "path": pa.list_(pa.string()), "types": pa.list_(pa.string())}))
#: Bytes of texts whose chunks are held at a time.
PORTION = 1 << 20


@dataclass
class Chunk:
    content: str
    level: int = 0
    path: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=lambda: ["text"])


def size(text: str) -> int:
    return len(text.encode())


def boundary(data: bytes, at: int) -> int:
    """``at``, or the next place between characters."""
    at = min(at, len(data))
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def windows(text: str, limit: int, overlap: int, slack: int, marks: Sequence[bytes]) -> list[str]:
    """Overlapping windows that together hold the whole text.

    A window ends after the last mark in its last part (the first kind of mark
    that occurs there), if that lies past the overlap; else at the limit.
    """
    data, out, start = text.encode(), [], 0
    while start < len(data):
        end = boundary(data, start + limit)
        if end < len(data):
            edge = boundary(data, start + limit + slack)
            for mark in marks:
                at = data.rfind(mark, start, edge)
                if at >= 0 and at + len(mark) - start > overlap:
                    end = at + len(mark)
                    break
        out.append(data[start:end].decode())
        if end >= len(data):
            break
        start = max(boundary(data, end - overlap), start + 1)
    return out


# Markdown


def header(line: str) -> tuple[int, str] | None:
    m = re.match(r"\s*(#{1,6})(?!#)(.*)$", line)
    return (len(m[1]), m[2].strip()) if m else None


@dataclass
class _Section:
    level: int
    path: list[str]
    title: str
    lines: list[str]

    @property
    def text(self) -> str:
        return "\n".join(self.lines).strip()

    @property
    def bare(self) -> bool:
        """Only a heading."""
        return not "\n".join(self.lines[1:] if self.level else self.lines).strip()


def sections(markdown: str) -> list[_Section]:
    """Sections by ATX headings outside code fences, each with the titles above it."""
    out = [_Section(0, [], "", [])]
    titles: dict[int, str] = {}
    fence = ""
    for line in re.split(r"\r?\n", markdown):
        mark = re.match(r"\s*(```+|~~~+)", line)
        if mark and (not fence or mark[1].startswith(fence)):
            fence = "" if fence else mark[1][:3]
        found = None if fence or mark else header(line)
        if found:
            level, title = found
            titles = {k: v for k, v in titles.items() if k < level} | {level: title}
            out.append(_Section(level, [titles[k] for k in sorted(titles)], title, [line]))
        else:
            out[-1].lines.append(line)
    return out


def split_markdown(markdown: str | None, limit: int = SIZE, overlap: int = OVERLAP) -> list[Chunk]:
    """A chunk for each section, or several for a long one.

    Sections that are only headings join the next section with text, or the one
    before if none follows.
    """
    whole: list[tuple[_Section, str]] = []
    pending: list[_Section] = []
    for s in sections(markdown or ""):
        if not s.text:
            continue
        if s.bare and s.level:
            pending.append(s)
            continue
        whole.append((s, "\n\n".join([p.text for p in pending] + [s.text])))
        pending = []
    if pending:
        tail = "\n\n".join(p.text for p in pending)
        if whole:
            s, text = whole[-1]
            whole[-1] = (s, f"{text}\n\n{tail}")
        else:
            whole.append((pending[-1], tail))
    out = []
    for s, text in whole:
        parts = [text] if size(text) <= limit else windows(text, limit, overlap, SLACK, (b"\n\n", b"\n"))
        out += [Chunk(p, s.level, list(s.path)) for p in parts]
    return out


# Plain text


def split_text(text: str | None, limit: int = SIZE, overlap: int = OVERLAP, reach: int = 100) -> list[Chunk]:
    """Windows that end at the first white space within ``reach`` bytes after the limit, if any; trimmed."""
    data, out, start = (text or "").encode(), [], 0
    while start < len(data):
        end = boundary(data, start + limit)
        if end < len(data) and (m := re.search(rb"\s", data[end : end + reach])):
            end += m.start()
        if part := data[start:end].decode().strip():
            out.append(Chunk(part))
        if end >= len(data):
            break
        after = boundary(data, end - overlap)
        start = after if after > start else end
    return out


def split_separators(text: str | None, separators: Sequence[str] = ("\n\n", "\n", ". ", " "), limit: int = SIZE, overlap: int = OVERLAP) -> list[Chunk]:
    """Parts at the first separator that occurs, packed up to the limit; windows if none occurs."""
    text = text or ""
    if size(text) <= limit:
        return [Chunk(text.strip())] if text.strip() else []
    sep = next((s for s in separators if s in text), None)
    if sep is None:
        return [Chunk(p) for p in windows(text, limit, overlap, 0, ())]
    out, held = [], ""
    for part in text.split(sep):
        joined = part if not held else held + sep + part
        if held and size(joined) > limit:
            out.append(held)
            held = part
        else:
            held = joined
    return [Chunk(x.strip()) for x in [*out, held] if x.strip()]


# Code

#: What begins a definition, by language; the last group is the name.
DEFINITIONS: dict[str, str] = {
    "rust": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(?:fn|struct|enum|trait|impl(?:<[^>]*>)?|mod)\s+(\w+)",
    "python": r"^\s*(?:async\s+)?(?:def|class)\s+(\w+)",
    "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\*?|class|const|let|var)\s+(\w+)",
    "go": r"^\s*(?:func\s+(?:\([^)]*\)\s*)?|type\s+)(\w+)",
    "": r"^\s*(?:\w+\s+)*(\w+)\s*\([^)]*\)\s*\{",
}
DEFINITIONS["typescript"] = DEFINITIONS["javascript"]
LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "ts": "typescript"}


def pack_lines(text: str, limit: int = SIZE, most: int = 100) -> list[str]:
    """Whole lines up to ``limit`` bytes and ``most`` lines a part."""
    out: list[str] = []
    held: list[str] = []
    total = 0
    for line in text.split("\n"):
        n = size(line) + 1
        if held and (total + n > limit or len(held) >= most):
            out.append("\n".join(held))
            held, total = [], 0
        held.append(line)
        total += n
    return [*out, "\n".join(held)] if held else out


def split_code(code: str | None, language: str = "", limit: int = SIZE) -> list[Chunk]:
    """Blocks that begin at definitions and end where braces balance (Python: at the next definition)."""
    language = LANGUAGES.get(language.lower(), language.lower())
    begins = re.compile(DEFINITIONS.get(language, DEFINITIONS[""]))
    blocks: list[tuple[str, int, list[str]]] = [("module", 0, [])]
    depth, inside = 0, False
    for line in (code or "").split("\n"):
        m = begins.match(line)
        top = not inside or language == "python" and not line[:1].isspace()
        if m and top:
            method = language == "go" and re.match(r"\s*func\s+\(", line)
            blocks.append((m[1], 2 if method else 1, []))
            inside, depth = True, 0
        blocks[-1][2].append(line)
        if inside and language != "python":
            depth += line.count("{") - line.count("}")
            if depth <= 0 and line.lstrip().startswith("}") or line.rstrip().endswith(";") and depth == 0:
                blocks.append(("module", 0, []))
                inside = False
    out = []
    for name, level, held in blocks:
        text = "\n".join(held).strip("\n")
        if text.strip():
            parts = [text] if size(text) <= limit else pack_lines(text, limit)
            out += [Chunk(p, level, [name], ["code", language or "text"]) for p in parts]
    return out


def register(spark: SparkSession) -> None:
    """Make the splitters SQL functions of a session: ``SELECT posexplode(split_text(text))``."""
    for name, split in (("split_markdown", split_markdown), ("split_text", split_text), ("split_separators", split_separators), ("split_code", split_code)):
        spark.udf.register(name, splitter(split))


def portions(texts: pa.Array, most: int = PORTION) -> Iterator[pa.Array]:
    """A batch in slices of some ``most`` bytes, as it is bounded by rows only; none is over by more than its last text."""
    before = np.cumsum([0, *pc.fill_null(pc.binary_length(texts), 0).to_pylist()])[:-1]
    for begin, end in pairwise([0, *np.flatnonzero(np.diff(before // most)) + 1, len(texts)]):
        yield texts.slice(begin, end - begin)


def splitter(split: Callable[..., list[Chunk]], **options):
    @F.arrow_udf(CHUNK)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in portions(texts):
                yield pa.array([[vars(c) for c in split(t, **options)] for t in part.to_pylist()], CHUNKS)

    return run


def chunks(column: Column, split: Callable[..., list[Chunk]], **options) -> Column:
    """A splitter as a column of chunk arrays; ``posexplode`` gives a row for each."""
    return splitter(split, **options)(column)
