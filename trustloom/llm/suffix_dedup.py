"""Suffix-array dedup (operator 1).

Sorts the word suffixes of all documents that begin a repeat of at least
`least` words, and reads the repeats off the common prefixes of neighbours.

Suffixes whose first `least` words occur once can't be in a repeat and are
never exchanged: a duplicate detection on fingerprints of those words finds
them. Of the others only those are sorted that can't be extended to the left
for all of their group alike, as their common prefixes imply the rest. Each
block sends these as sorted, front-coded runs; equal beginnings meet in one
reducer, where a loser tree merges the runs. It knows each candidate's common
prefix with the last winner and compares bytes only beyond that.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _exchange, _text

LEAST = 50
REPEATS = "doc_id bigint, start bigint, n_words bigint, other_id bigint, other_start bigint"
_RUN = "part int, block int, n int, run binary"


def common_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of a and b, which agree up to at."""
    m = min(len(a), len(b))
    step = 64
    while at < m and a[at : at + step] == b[at : at + step]:
        at += step
        step *= 2
    if at >= m:
        return m
    hi = min(at + step, m)
    while at < hi:  # the first difference, or m, lies in [at, hi]
        mid = (at + hi) // 2
        if a[at : mid + 1] == b[at : mid + 1]:
            at = mid + 1
        else:
            hi = mid
    return at


class LoserTree:
    """Merges sorted runs of (string, its common prefix with the one before it in the run, what belongs to it).

    Yields (string, common prefix with the string yielded before, what belongs
    to it). Runs are read as they are needed, so one string of each is in
    memory. Every string that waits keeps the length of its common prefix with
    the winner it lost to; two that lost to the same winner are told apart by
    these lengths, and only equal ones need bytes, from there on.
    """

    def __init__(self, runs: list[Iterable[tuple[bytes, int, object]]]):
        self.k = 1
        while self.k < len(runs):
            self.k *= 2
        self.runs = [iter(r) for r in runs] + [iter(())] * (self.k - len(runs))
        self.compared = 0

    def _beats(self, x: list, y: list) -> bool:
        """Whether x comes before y; the loser's length is then that with the winner."""
        if x[0] is None or y[0] is None:
            return x[0] is not None
        if x[1] != y[1]:
            return x[1] > y[1]  # the loser's prefix with the winner is its own already
        at = common_prefix(x[0], y[0], x[1])
        self.compared += at - x[1] + 1
        first = at == len(x[0]) or at < len(y[0]) and x[0][at] < y[0][at]
        (y if first else x)[1] = at
        return first

    def _next(self, run: int) -> list:
        got = next(self.runs[run], None)
        return [None, 0, run, None] if got is None else [got[0], got[1], run, got[2]]

    def __iter__(self) -> Iterator[tuple[bytes, int, object]]:
        k = self.k
        lost: list = [None] * k

        def build(node: int) -> list:
            if node >= k:
                return self._next(node - k)
            a, b = build(2 * node), build(2 * node + 1)
            if not self._beats(a, b):
                a, b = b, a
            lost[node] = b
            return a

        top = build(1)
        while top[0] is not None:
            s, prefix, run, what = top
            yield s, prefix, what
            now = self._next(run)
            node = (run + k) // 2
            while node:
                if not self._beats(now, lost[node]):
                    now, lost[node] = lost[node], now
                node //= 2
            top = now


def words_in(a: bytes, b: bytes, prefix: int) -> int:
    """Whole words of a and b, joined by single spaces, in their common prefix."""
    n = a.count(b" ", 0, prefix)
    ends = lambda s: prefix == len(s) or s[prefix] == 32
    return n + (prefix > 0 and a[prefix - 1] != 32 and ends(a) and ends(b))


def front_code(rows: list[tuple[bytes, int, int]]) -> bytes:
    """A sorted run of (suffix, document, start): each without what it shares with the one before."""
    prefixes, rests, last = [], [], b""
    for s, _, _ in rows:
        p = common_prefix(last, s)
        prefixes.append(p)
        rests.append(s[p:])
        last = s
    parts = [np.array(prefixes, np.int64), np.array([len(r) for r in rests], np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in parts) + b"".join(rests))


def front_decode(blob: bytes, n: int) -> Iterator[tuple[bytes, int, tuple[int, int]]]:
    """Suffixes, their common prefixes with the one before, and (document, start), one at a time.

    The run stays compressed; what is read of it at a time are four numbers a
    suffix and a piece of its characters.
    """
    with zstandard.ZstdDecompressor().stream_reader(blob) as reader:
        numbers = b""
        while len(numbers) < 32 * n:
            numbers += reader.read(32 * n - len(numbers))
        prefix, size, doc, start = (np.frombuffer(numbers, np.int64, n, i * 8 * n) for i in range(4))
        last, held, at = b"", b"", 0
        for i in range(n):
            m = int(size[i])
            if len(held) - at < m:
                parts, have = [held[at:]], len(held) - at
                while have < m:
                    parts.append(reader.read(max(m - have, 1 << 16)))
                    have += len(parts[-1])
                held, at = b"".join(parts), 0
            last = last[: prefix[i]] + held[at : at + m]
            at += m
            yield last, int(prefix[i]), (int(doc[i]), int(start[i]))


def _windows(texts: list[str], least: int) -> Iterator[tuple[_text.Words, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk: words, pointers by document, fingerprints and left neighbours (0: none) of the windows."""
    for w in _text.words(texts):
        h, ptr = _text.ngrams(w, least)
        per = np.diff(ptr)
        first = np.repeat(w.ptr[:-1] - ptr[:-1], per) + np.arange(len(h))
        left = w.hashes[np.maximum(first - 1, 0)] >> np.uint64(64 - _exchange.BITS) | np.uint64(1)
        left[ptr[:-1][per > 0]] = 0
        yield w, ptr, h >> np.uint64(64 - _exchange.BITS), left


def _distinct(f: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct fingerprints, where each window is in them, counts, and the left neighbour, 0 for several."""
    each, back, many = np.unique(f, return_inverse=True, return_counts=True)
    low, high = np.zeros(len(each), np.uint64), np.zeros(len(each), np.uint64)
    o = np.argsort(back, kind="stable")
    start = np.cumsum(many) - many
    if len(each):
        low, high = np.minimum.reduceat(left[o], start), np.maximum.reduceat(left[o], start)
    return each, back, many, np.where(low == high, low, np.uint64(0))


def suffix_runs(docs: DataFrame, least: int, key: str, text: str) -> DataFrame:
    """Sorted runs, a partition for each range of first fingerprints, as many as blocks."""
    blocked = _exchange.blocks(docs, F.col(f"`{key}`"), F.col(f"`{text}`"))
    parts = blocked.n

    def all_windows(docs: _exchange.Docs) -> tuple[np.ndarray, np.ndarray]:
        got = [(f, left) for _, _, f, left in _windows(docs[1], least)]
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])

    def emit(docs: _exchange.Docs, answers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        each = np.unique(all_windows(docs)[0])
        return each, np.zeros(len(each), np.uint16)

    def repeated(f: np.ndarray, payload: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])) if len(f) else np.zeros(0, np.int64)
        n = np.diff(np.append(start, len(f)))
        return np.repeat((n > 1).astype(np.uint32), n), np.arange(2, dtype=np.uint64)[:, None]

    # only windows that other blocks have too need their left neighbours compared there
    def emit_left(docs: _exchange.Docs, answers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        each, _, _, left = _distinct(*all_windows(docs))
        shared = answers[0][0] > 0 if answers[0].size else np.zeros(len(each), dtype=bool)
        return each[shared], left[shared]

    def heads_of(f: np.ndarray, left: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = np.arange(2, dtype=np.uint64)[:, None]  # the first of a repeat or not
        if not len(f):
            return np.zeros(0, np.uint32), words
        start = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
        low, high = np.minimum.reduceat(left, start), np.maximum.reduceat(left, start)
        head = (low != high) | (low == 0)
        return np.repeat(head.astype(np.uint32), np.diff(np.append(start, len(f)))), words

    arrow = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("run", pa.binary())])

    def finish(block: int, docs: _exchange.Docs, answers: list[np.ndarray]) -> pa.Table:
        runs: list[list] = [[] for _ in range(parts)]
        keys = docs[0].tolist()
        if answers[0].size:
            shared = answers[0][0] > 0
            each, back, many, left = _distinct(*all_windows(docs))
            repeats = shared | (many > 1)
            heads = repeats & (left == 0)
            if answers[1].size:
                heads[shared] |= answers[1][0] > 0
            done = 0
            for w, ptr, f, _ in _windows(docs[1], least):
                i = back[done : done + len(f)]
                done += len(f)
                inside, head = repeats[i], np.flatnonzero(heads[i])
                if not len(head):
                    continue
                # the end of the stretch of repeated windows that each head is in
                stop = np.flatnonzero(np.append(~inside, True))
                last = stop[np.searchsorted(stop, head)]
                doc = np.searchsorted(ptr, head, side="right") - 1
                last = np.minimum(last, ptr[doc + 1]) - 1
                begin = w.ptr[doc] + head - ptr[doc]
                until = begin + (last - head) + least
                flat = np.full(len(w.buf), 32, np.uint8)  # the chunk with single spaces between words
                gap = w.starts - np.concatenate([[0], w.ends[:-1] + 1])
                shift = np.cumsum(gap)
                a = np.frombuffer(w.buf, np.uint8)
                at, own = _text.ragged(w.starts, w.ends - w.starts)
                flat[at - shift[own]] = a[at]
                line = flat.tobytes()
                lo, hi = w.starts[begin] - shift[begin], w.ends[until - 1] - shift[until - 1]
                where = (f[head].astype(np.float64) * (parts / float(1 << _exchange.BITS))).astype(np.int64)
                for p, x, y, d, s in zip(where.tolist(), lo.tolist(), hi.tolist(), doc.tolist(), (head - ptr[doc]).tolist()):
                    runs[p].append((line[x:y], keys[w.first + d], s))
        rows = [(p, len(r), front_code(sorted(r))) for p, r in enumerate(runs) if r]
        return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([block] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], schema=arrow)

    answers = _exchange.ask(blocked, emit_left, heads_of, _exchange.ask(blocked, emit, repeated), np.uint64)
    return _exchange.finish(blocked, answers, 2, finish, _RUN).repartitionById(parts, "part")


def suffix_dedup(docs: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, n_words, other_id, other_start): repeats of at least `least` words.

    Words as in _text, whatever the case and punctuation; start counts them
    from 0. A row says that n_words words of doc_id from start stand also in
    other_id (it may be the same document) from other_start. The rows are the
    neighbours in suffix order, of each start the longest repeat; together
    they cover every window of `least` words that occurs more than once
    anywhere. Null keys, null texts and texts of fewer words have no rows;
    rows repeated whole are copies of each other. Only the two named columns
    are read.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("other_id", pa.int64()), ("other_start", pa.int64())])

    def merge(table: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int, int]] = []
        last: tuple[bytes, int, int] | None = None
        before = (0, -1, -1)  # words shared with the suffix before the last one, and where that stands
        for s, prefix, (doc, start) in LoserTree([front_decode(b.as_py(), n.as_py()) for b, n in zip(table["run"], table["n"])]):
            if last is not None:
                n = words_in(last[0], s, prefix)
                best = before if before[0] >= n else (n, doc, start)
                if best[0] >= least:
                    out.append((last[1], last[2], *best))
                before = (n, last[1], last[2])
            last = (s, doc, start)
        if last is not None and before[0] >= least:
            out.append((last[1], last[2], *before))
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)], schema=arrow)

    return suffix_runs(docs, least, key, text).groupBy("part").applyInArrow(merge, REPEATS)
