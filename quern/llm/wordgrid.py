"""Words of many texts as numpy columns, with polynomial hashes of words and of windows of words."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
STEP = 0xD6E8FEB86659FD93
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[9, 10, 11, 12, 13, 32]] = True


#: Bytes that are hashed at once (and the word that ends there): about 60 times as much memory is used meanwhile.
CHUNK = 1 << 20
BLANK = re.compile(rb"[ \t-\r]")


@dataclass
class WordGrid:
    """For each word the index of its text and the hash of the word."""

    doc: np.ndarray
    code: np.ndarray


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(size, BASE, np.uint64)
    down = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _words(part: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, code) of each word."""
    buf = np.frombuffer(part, np.uint8)
    solid = np.zeros(len(buf) + 2, np.int8)
    solid[1:-1] = ~IS_BLANK[buf]
    edges = np.flatnonzero(np.diff(solid))
    first, last = edges[0::2], edges[1::2]
    up, down = _powers(1 << max(20, int(len(buf)).bit_length()))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    return first, scramble((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def word_grid(parts: list[bytes]) -> WordGrid:
    """All words of the given texts. Equal words get equal codes wherever they stand. Long texts are read in chunks that end
    at a blank, so memory follows the number of words, not 60 times the bytes."""
    whole = b"\n".join(parts) + b"\n"
    firsts, codes, at = [], [], 0
    while at < len(whole):
        blank = BLANK.search(whole, at + CHUNK) if at + CHUNK < len(whole) else None
        end = blank.end() if blank else len(whole)
        first, code = _words(whole[at:end])
        firsts.append(first + at)
        codes.append(code)
        at = end
    begins = np.zeros(len(parts), np.int64)
    np.cumsum([len(p) + 1 for p in parts[:-1]], out=begins[1:]) if len(parts) > 1 else None
    return WordGrid(np.searchsorted(begins, np.concatenate(firsts), "right") - 1, np.concatenate(codes))


def window_codes(grid: WordGrid, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp codes of each window of `width` words within one text, and the index of its first word."""
    n = len(grid.code) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total *= np.uint64(STEP)
        total += grid.code[k : n + k]
    at = np.flatnonzero(grid.doc[:n] == grid.doc[width - 1 :])
    return scramble(total[at]), at
