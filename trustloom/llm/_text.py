"""Vectorised words and word n-grams of batches of texts.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII
characters of the lower-cased text. Words and n-grams are held as 64-bit
hashes that numpy computes for a whole batch at once from prefix sums, so no
Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: The same words in RE2 syntax, over the lower-cased text.
WORD_SQL = r"[0-9a-z_\x{80}-\x{10FFFF}]+"

_U = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}
CHUNK_BYTES = 1 << 20

IS_WORD = np.zeros(256, dtype=bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (95, 96), (128, 256)):
    IS_WORD[_lo:_hi] = True


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    have = _POW.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, CHUNK_BYTES + 4096)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = both[0], both[1]
        if n <= 4 * CHUNK_BYTES:
            _POW[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


@dataclass
class Words:
    """Words of docs[first : first + len(ptr) - 1]; ptr[k]:ptr[k+1] are one document's."""

    first: int
    ptr: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    buf: bytes

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]]

    def text(self, lo: int, hi: int) -> list[bytes]:
        s, e, b = self.starts, self.ends, self.buf
        return [b[s[i] : e[i]] for i in range(lo, hi)]


def words(texts: list[str | None], lower: bool = True) -> Iterator[Words]:
    """The texts in chunks of about CHUNK_BYTES; None counts as empty."""
    group: list[bytes] = []
    size, first = 0, 0
    for k, t in enumerate(texts):
        b = ((t.lower() if lower else t) if t else "").encode("utf-8", "surrogatepass")
        if group and size + len(b) > CHUNK_BYTES:
            yield _chunk(first, group)
            group, size, first = [], 0, k
        group.append(b)
        size += len(b) + 1
    if group:
        yield _chunk(first, group)


def _chunk(first: int, group: list[bytes]) -> Words:
    buf = b"\n".join(group) + b"\n"
    a = np.frombuffer(buf, dtype=np.uint8)
    is_word = IS_WORD[a].view(np.int8)
    edge = np.diff(is_word, prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = span_hashes(a, starts, ends)
    begin = np.zeros(len(group) + 1, dtype=np.int64)
    np.cumsum([len(b) + 1 for b in group], out=begin[1:])
    return Words(first, np.searchsorted(starts, begin), hashes, starts, ends, buf)


def span_hashes(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the bytes a[lo[i] : hi[i]]."""
    p, inv = _powers(_BYTE_BASE, len(a) + 1)
    h = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum((a.astype(np.uint64) + _U(1)) * p[: len(a)], out=h[1:])
    return mix((h[hi] - h[lo]) * inv[lo] + (hi - lo).astype(np.uint64))


def ngrams(w: Words, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of every document, and their pointers by document.

    short: a document of 1 to n - 1 words has one window, all of it.
    """
    count = np.diff(w.ptr)
    per = np.maximum(count - n + 1, 0)
    p, inv = _powers(_WORD_BASE, len(w.hashes) + 1)
    g = np.zeros(len(w.hashes) + 1, dtype=np.uint64)
    np.cumsum(w.hashes * p[: len(w.hashes)], out=g[1:])
    size = np.full(len(count), n, dtype=np.int64)
    if short:
        few = (count > 0) & (count < n)
        per[few] = 1
        size[few] = count[few]
    ptr = np.zeros(len(count) + 1, dtype=np.int64)
    np.cumsum(per, out=ptr[1:])
    at = np.repeat(w.ptr[:-1] - ptr[:-1], per) + np.arange(ptr[-1])
    long = np.repeat(size, per)
    return mix((g[at + long] - g[at]) * inv[at] + long.astype(np.uint64)), ptr


def word_hash(word: str) -> int:
    """The hash that words() gives a single word."""
    w = _chunk(0, [word.lower().encode()])
    if len(w.hashes) != 1:
        raise ValueError(f"not one word: {word!r}")
    return int(w.hashes[0])


def ragged(lo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges lo[i] : lo[i] + count[i], all positions and for each the i."""
    owner = np.repeat(np.arange(len(lo)), count)
    begin = np.cumsum(count) - count
    return np.arange(len(owner)) - np.repeat(begin - lo, count), owner
