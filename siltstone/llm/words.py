"""Words of texts as hashes, without a Python object for each."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = np.random.Generator(np.random.PCG64(3)).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, x in enumerate((_BASE, _BACK)):
            step = np.full(size, x, dtype=np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=np.uint64)
    return _powers[0], _powers[1]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(a 64-bit hash of each word of all texts, words of each text, all bytes, (begins, ends)).

    ASCII letters are lower-cased. The hash is a polynomial in all bytes of a
    word: a difference of two running sums, moved to the same power.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buffer = np.frombuffer(b" " + b"\n".join(parts).lower() + b" ", dtype=np.uint8)
    space = SPACE[buffer]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = powers(len(buffer))
    upto = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[buffer] * up[: len(buffer)], out=upto[1:])
    h = (upto[ends] - upto[starts]) * down[starts]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1
    # A text's words end before the line feed that follows it.
    last = np.searchsorted(starts, 1 + np.cumsum(sizes))
    return h, np.diff(last, prepend=0), buffer, (starts, ends)
