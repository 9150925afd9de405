"""BPE encoding and decoding by dynamic programming over prefixes (operator 7).

For every prefix of a piece exactly one token can be the last of its encoding:
of the tokens that end there (the matches of an Aho-Corasick suffix automaton)
the one that is compatible with the last token of the prefix before it. These
are found for all new pieces of a batch at once; back-pointers give the ids.
Pieces are what the vocabulary's own splitting pattern yields; each is encoded
once and kept in a bounded table of the worker.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import ragged, span_hashes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENCODED = "doc_id bigint, n_tokens bigint, token_ids array<int>, round_trip boolean"
_BIG = np.int64(1) << 40
_CHUNK = 1 << 20


class Vocabulary:
    """Tables of a rank file: the suffix automaton, the merges and the tokens' bytes."""

    def __init__(self, lines: bytes, pattern: str = PATTERN):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x)}
        self.pattern = pattern
        size = max(ranks.values()) + 1
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        by_id = [b""] * size
        for t, r in ranks.items():
            by_id[r] = t
        self.length = np.array([len(t) for t in by_id], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        # -1 in left: a single byte, or a token that merging its own bytes never gives
        self.left = np.full(size, -1, dtype=np.int64)
        self.right = np.full(size, -1, dtype=np.int64)
        dead = set()
        for t, r in ranks.items():
            if len(t) > 1:
                parts = _merge(t, ranks, r)
                if len(parts) == 2:
                    self.left[r], self.right[r] = ranks[parts[0]], ranks[parts[1]]
                else:
                    dead.add(t)
        made = np.flatnonzero(self.left >= 0)
        keys = (self.left[made] << 20) | self.right[made]
        order = np.argsort(keys)
        self.merged = _Map(keys[order], made[order])
        self._automaton({t: r for t, r in ranks.items() if t not in dead})

    def _automaton(self, ranks: dict[bytes, int]) -> None:
        child: list[dict[int, int]] = [{}]
        token = [-1]
        for t, r in ranks.items():
            s = 0
            for b in t:
                n = child[s].get(b)
                if n is None:
                    n = len(child)
                    child[s][b] = n
                    child.append({})
                    token.append(-1)
                s = n
            token[s] = r
        fail, out = [0] * len(child), [-1] * len(child)
        queue = list(child[0].values())
        for s in queue:
            f = fail[s]
            out[s] = f if token[f] >= 0 else out[f]
            for b, n in child[s].items():
                g = f
                while g and b not in child[g]:
                    g = fail[g]
                fail[n] = child[g].get(b, 0)
                queue.append(n)
        edges = sorted((s << 8 | b, n) for s, c in enumerate(child) for b, n in c.items())
        self.edge = _Map(np.array([k for k, _ in edges], dtype=np.int64), np.array([n for _, n in edges], dtype=np.int64))
        self.token = np.array(token, dtype=np.int64)
        self.fail = np.array(fail, dtype=np.int64)
        self.out = np.array(out, dtype=np.int64)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        state = state.copy()
        todo = np.arange(len(state))
        while len(todo):
            to = self.edge.get(state[todo] << 8 | byte[todo])
            ok = to >= 0
            state[todo[ok]] = to[ok]
            todo = todo[~ok]  # each single byte is an edge of the root
            state[todo] = self.fail[state[todo]]
        return state

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves a and b as they are where they meet.

        The merges that made the two are undone from the last one on, along the
        seam; had the parts at the seam a merge of lower rank than the undone
        one, BPE would have taken that.
        """
        good = np.ones(len(a), dtype=bool)
        who, a, b = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), _BIG)
        while len(who):
            made = self.merged.get(a << 20 | b)
            crossed = (made >= 0) & (made < limit)
            good[who[crossed]] = False
            can_a, can_b = self.left[a] >= 0, self.left[b] >= 0
            undo_a = can_a & ((a > b) | ~can_b)
            undo_b = can_b & ~undo_a
            limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
            a = np.where(undo_a, self.right[a], a)
            b = np.where(undo_b, self.left[b], b)
            go = (undo_a | undo_b) & ~crossed
            who, a, b, limit = who[go], a[go], b[go], limit[go]
        return good

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, pointers) of the encodings of pieces."""
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int64)
        order = np.argsort(-size, kind="stable")
        begin = (np.cumsum(size) - size)[order]
        size = size[order]
        row = np.cumsum(size + 1) - (size + 1)
        last = np.full(int((size + 1).sum()), -1, dtype=np.int64)
        state = np.zeros(len(size), dtype=np.int64)
        longest = int(size[0]) if len(size) else 0
        for i in range(1, longest + 1):
            n = int(np.searchsorted(-size, -i, side="right"))
            state = self.step(state[:n], flat[begin[:n] + i - 1])
            node = np.where(self.token[state] >= 0, state, self.out[state])
            todo = np.arange(n)
            while len(todo):
                t = self.token[node]
                before = i - self.length[t]
                prev = last[row[todo] + before]
                ok = before == 0
                ask = np.flatnonzero(~ok)
                ok[ask] = self.compatible(prev[ask], t[ask])
                last[row[todo[ok]] + i] = t[ok]
                todo, node = todo[~ok], self.out[node[~ok]]
        # back-pointers, all pieces at once from their ends
        at, who = size.copy(), np.arange(len(size))
        steps = []
        while len(who := who[at[who] > 0]):
            t = last[row[who] + at[who]]
            steps.append((who, t))
            at[who] -= self.length[t]
        count = np.zeros(len(size), dtype=np.int64)
        for w, _ in steps:
            count[w] += 1
        back = np.empty(len(size), dtype=np.int64)
        back[order] = np.arange(len(size))
        ptr = np.concatenate([[0], np.cumsum(count[back])])
        ids = np.empty(int(ptr[-1]), dtype=np.int32)
        end = ptr[1:][order]
        for k, (w, t) in enumerate(steps):
            ids[end[w] - 1 - k] = t
        return ids, ptr

    def decode(self, ids: np.ndarray) -> bytes:
        at, _ = ragged(self.start[ids], self.length[ids])
        return self.bytes[at].tobytes()


def _merge(t: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """What merging by rank leaves of t if only ranks under below exist."""
    parts = [bytes([b]) for b in t]
    while len(parts) > 1:
        best, at = below, -1
        for k in range(len(parts) - 1):
            r = ranks.get(parts[k] + parts[k + 1], below)
            if r < best:
                best, at = r, k
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class _Map:
    """Open addressing: int64 keys (not negative) to int64 values, looked up many at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.value = np.full(1 << self.bits, -1, dtype=np.int64)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.key[at[todo]] < 0
            self.key[at[todo[free]]] = keys[todo[free]]  # of several one stays
            ok = self.key[at[todo]] == keys[todo]
            self.value[at[todo[ok]]] = values[todo[ok]]
            todo = todo[~ok]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        at = self._slot(keys)
        out = self.value[at]
        there = self.key[at]
        todo = np.flatnonzero((there != keys) & (there >= 0))
        out[(there < 0)] = -1
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            there = self.key[at[todo]]
            out[todo] = np.where(there == keys[todo], self.value[at[todo]], -1)
            todo = todo[(there != keys[todo]) & (there >= 0)]
        return out


class _Table(dict):
    """Numbers its keys as they first appear."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


_SPACE, _NEWLINE = 32, 10
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _irregular(a: np.ndarray) -> np.ndarray:
    """Where a stands white space that is neither a space nor a newline, or that meets other white space."""
    blank = _BLANK[a]
    bad = blank & (a != _SPACE) & (a != _NEWLINE)
    bad[1:] |= blank[1:] & blank[:-1]
    if (a >= 0xC2).any():
        b, c = np.append(a[1:], 0), np.append(a[2:], [0, 0])
        bad |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        bad |= (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
        bad |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F))
    return bad


class Encoder:
    """Encodes texts; keeps at most about `most` distinct pieces before it starts its tables anew.

    Regular texts are cut before each single space and around each newline,
    where the pattern always cuts; these chunks are known by a 64-bit hash.
    What a chance collision could spoil shows when the ids are decoded:
    then the text is encoded without the table.
    """

    def __init__(self, vocabulary: Vocabulary, most: int = 200_000):
        self.v, self.most = vocabulary, most
        self.pattern = regex.compile(vocabulary.pattern)
        self._reset()

    def _reset(self) -> None:
        self.pieces = _Table()
        self.ids, self.ptr = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.chunk_ids, self.chunk_ptr = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _encode_found(self, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, pointers) of lists of pieces."""
        count = np.array([len(f) for f in found], dtype=np.int64)
        index = np.fromiter(map(self.pieces.__getitem__, chain.from_iterable(found)), dtype=np.int64, count=int(count.sum()))
        new = list(islice(self.pieces, len(self.ptr) - 1, None))
        if new:
            ids, ptr = self.v.encode_pieces([p.encode() for p in new])
            self.ptr = np.concatenate([self.ptr, self.ptr[-1] + ptr[1:]])
            self.ids = np.concatenate([self.ids, ids])
        size = self.ptr[index + 1] - self.ptr[index]
        at, _ = ragged(self.ptr[index], size)
        return self.ids[at], np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])]

    def _slow(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._encode_found([self.pattern.findall(t) for t in texts])

    def _regular(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        buf = b"".join(texts)
        a = np.frombuffer(buf, dtype=np.uint8)
        head = a == _NEWLINE
        head[1:] |= head[:-1]
        head |= a == _SPACE
        size = np.array([len(t) for t in texts], dtype=np.int64)
        begin = np.cumsum(size) - size
        head[begin[size > 0]] = True
        lo = np.flatnonzero(head)
        hi = np.append(lo[1:], len(a))
        h = span_hashes(a, lo, hi)
        each, first, back = np.unique(h, return_index=True, return_inverse=True)
        i = np.minimum(np.searchsorted(self.known, each), max(len(self.known) - 1, 0))
        have = self.known[i] == each if len(self.known) else np.zeros(len(each), dtype=bool)
        fresh = np.flatnonzero(~have)
        at = first[fresh]
        chunks = [buf[x:y].decode() for x, y in zip(lo[at].tolist(), hi[at].tolist())]
        plain = np.add.reduceat(~_LETTER[a], lo)[at] - (a[lo[at]] == _SPACE) if len(a) else np.zeros(0)
        simple = (plain == 0) & ((hi - lo)[at] > 1)
        findall = self.pattern.findall
        ids, ptr = self._encode_found([[c] if one else findall(c) for c, one in zip(chunks, simple.tolist())])
        number = np.empty(len(each), dtype=np.int64)
        number[have] = self.number[i[have]]
        number[fresh] = np.arange(len(fresh)) + len(self.chunk_ptr) - 1
        self.chunk_ids = np.concatenate([self.chunk_ids, ids])
        self.chunk_ptr = np.concatenate([self.chunk_ptr, self.chunk_ptr[-1] + ptr[1:]])
        known, number_ = np.concatenate([self.known, each[fresh]]), np.concatenate([self.number, number[fresh]])
        order = np.argsort(known, kind="stable")
        self.known, self.number = known[order], number_[order]
        index = number[back]
        n = self.chunk_ptr[index + 1] - self.chunk_ptr[index]
        at, _ = ragged(self.chunk_ptr[index], n)
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.chunk_ids[at], ends[np.searchsorted(lo, np.append(begin, len(a)))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, pointers by text) of the concatenated encodings."""
        if len(self.known) > self.most or len(self.pieces) > self.most:
            self._reset()
        raw = [t.encode() for t in texts]
        ends = np.cumsum([len(r) + 1 for r in raw])
        a = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
        bad = np.zeros(len(raw), dtype=bool)
        # the newline put after each text shows white space at its end; at its start it is seen here
        bad[np.searchsorted(ends, np.flatnonzero(_irregular(a)), side="right")] = True
        if not bad.any():
            return self._regular(raw)
        two = [self._regular([r for r, b in zip(raw, bad) if not b]), self._slow([t for t, b in zip(texts, bad) if b])]
        parts, k = [], [0, 0]
        for b in bad.tolist():
            ids, ptr = two[b]
            parts.append(ids[ptr[k[b]] : ptr[k[b] + 1]])
            k[b] += 1
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def encode_checked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        """encode(), and whether each text came back from its ids."""
        ids, ptr = self.encode(texts)
        size = self.v.length[ids]
        if self.v.decode(ids) == "".join(texts).encode() and (np.concatenate([[0], np.cumsum(size)])[ptr] == np.cumsum([0, *(len(t.encode()) for t in texts)])).all():
            return ids, ptr, [True] * len(texts)
        self._reset()
        ids, ptr = self._slow(texts)
        return ids, ptr, [self.v.decode(ids[ptr[k] : ptr[k + 1]]) == t.encode() for k, t in enumerate(texts)]


_WORKER: dict[str, Encoder] = {}


def bpe_encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, token_ids, round_trip) of every row of docs.

    The ids are those of the rank file's own BPE over pieces of `pattern`,
    without special tokens; round_trip says whether decoding them gave the
    text back. The driver reads the rank file (its size doesn't grow with the
    data) and broadcasts the tables. A null text gives nulls, an empty one an
    empty array; keys are passed through, null or repeated. Only the two named
    columns are read.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        lines = f.read()
    shared = spark.sparkContext.broadcast(Vocabulary(lines, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{vocabulary}\0{pattern}"
        coder = _WORKER.get(name)
        if coder is None:
            _WORKER.clear()
            coder = _WORKER[name] = Encoder(shared.value)
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            lo = 0
            while lo < len(column):
                texts, size, hi = [], 0, lo
                while hi < len(column) and (not texts or size < _CHUNK):
                    texts.append(column[hi].as_py())
                    size += len(texts[-1] or "")
                    hi += 1
                ids, ptr, ok = coder.encode_checked([t or "" for t in texts])
                ok = [None if t is None else x for t, x in zip(texts, ok)]
                null = np.array([t is None for t in texts] + [False])
                lists = pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32), mask=null), pa.array(ids))
                n = pa.array(np.diff(ptr), mask=null[:-1])
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), n, lists, pa.array(ok, pa.bool_())], ["doc_id", "n_tokens", "token_ids", "round_trip"])
                lo = hi

    return docs.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{text}`").alias("t")).mapInArrow(run, ENCODED)


def bpe_decode(encoded: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """(doc_id, text) of rows of token ids; null ids, or bytes that aren't UTF-8, give null."""
    with open(vocabulary, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in (x.split() for x in f.read().splitlines() if x)}
    size = max(ranks) + 1
    by_id = [ranks.get(i, b"") for i in range(size)]
    shared = encoded.sparkSession.sparkContext.broadcast(by_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                try:
                    out.append(None if x is None else b"".join([table[i] for i in x]).decode())
                except UnicodeDecodeError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{ids}`").alias("i")).mapInArrow(run, "doc_id bigint, text string")
