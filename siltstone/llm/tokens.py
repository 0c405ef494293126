"""Token ids of whole texts, by the tokenizers library."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Pieces whose ids a worker remembers.
MOST_PIECES = 400_000
#: Characters encoded at a time.
BLOCK_CHARS = 1_000_000
#: Characters whose classes are the same in every version of Unicode that has them.
LAST = 0x250


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as little-endian integers of ``width`` bytes.

    A byte-level BPE encodes the pieces of its split on their own. Where the
    split's classes are certain (texts without characters beyond U+024F or
    control characters), each different piece goes to the tokenizer once and
    its ids are remembered; every other text goes to it whole. A text with such
    a character has a piece with one, which is never remembered. A text that
    holds the string of an added token, such as an end of text, goes to the
    tokenizer whole too, which gives that token's id for it.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core, and threads cost memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        spec = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in spec["added_tokens"]]
        pre = spec["pre_tokenizer"] or {}
        self.by_piece = (
            spec["normalizer"] is None
            and spec["model"]["type"] == "BPE"
            and not spec["model"].get("dropout")
            and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) == ("ByteLevel", False, True)
        )
        of = lambda kind: "".join(re.escape(chr(c)) for c in range(LAST) if unicodedata.category(chr(c))[0] == kind)
        letters, digits, space = of("L"), of("N"), r"\t\n\x0b\x0c\r \x85\xa0"
        self.odd = re.compile(rf"[^\t\n\x0b\x0c\r\x20-\x7e\x85\xa0-{chr(LAST - 1)}]").search
        self.split = re.compile(
            rf" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{digits}]+| ?[^{space}{letters}{digits}]+|[{space}]+(?![^{space}])|[{space}]+"
        ).findall
        self.spaced = re.compile(rf" [{letters}]+").fullmatch
        # Only the first token of a piece that begins with a space holds a space (as \u0120).
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        self.begins[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
        self.known = _Known()

    def _has_added(self, text: str) -> bool:
        return any(a in text for a in self.added)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _new(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces. Those that begin with a space are encoded in a row, and cut at spaces."""
        rows: list[str] = []
        rest: list[str] = []
        spaced = self.spaced
        for p in pieces:
            (rows if spaced(p) else rest).append(p)
        out: dict[str, bytes] = {}
        parts = [rows[i : i + 256] for i in range(0, len(rows), 256)]
        lines = ["".join(p) for p in parts]
        for part, row, e in zip(parts, lines, self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)):
            ids = np.array(e.ids, dtype=self.dtype)
            cut = (np.append(np.flatnonzero(self.begins[ids]), len(ids)) * self.width).tolist()
            if len(cut) == len(part) + 1 and not self._has_added(row):
                data = ids.tobytes()
                out.update(zip(part, [data[a:b] for a, b in zip(cut, cut[1:])]))
            else:
                rest += part
        out.update(zip(rest, self._whole(rest)))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; so many texts at a time that their pieces stay few."""
        out: list[bytes] = []
        begin = held = 0
        for i, t in enumerate(texts):
            if held and held + len(t) > BLOCK_CHARS:
                out += self._block(texts[begin:i])
                begin, held = i, 0
            held += len(t)
        return out + self._block(texts[begin:])

    def _block(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return self._whole(texts)
        known = self.known
        get, lost = known.__getitem__, known.lost
        lost.clear()
        rows, seen = [], [0]
        whole = [k for k, t in enumerate(texts) if self._has_added(t)]
        apart = set(whole)
        for k, t in enumerate(texts):
            rows.append([] if k in apart else list(map(get, self.split(t))))
            seen.append(len(lost))
        new = self._new(list(set(lost)))
        odd = {p for p in new if self.odd(p)}
        if len(known) + len(new) <= MOST_PIECES:
            known.update((p, ids) for p, ids in new.items() if p not in odd)
        for k, row in enumerate(rows):
            missing = lost[seen[k] : seen[k + 1]]
            if odd and not odd.isdisjoint(missing):
                whole.append(k)
                continue
            i = -1
            for p in missing:
                i = row.index(None, i + 1)
                row[i] = new[p]
        at = dict(zip(whole, self._whole([texts[k] for k in whole]))) if whole else {}
        return [at[k] if k in at else b"".join(row) for k, row in enumerate(rows)]


class _Known(dict):
    """Ids by piece; notes what is asked for in vain."""

    def __init__(self):
        super().__init__()
        self.lost: list[str] = []

    def __missing__(self, piece: str) -> None:
        self.lost.append(piece)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)
