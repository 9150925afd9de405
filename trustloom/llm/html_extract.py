"""HTML extraction with a host suffix array (operator 3).

A page's visible text becomes a token stream. The streams of a host are
concatenated into a suffix array with common prefixes; the longest prefix that a
suffix has in common with one of another page is a repeated substring. Tokens
that such substrings of some length cover are removed, the runs between them
stay. A host of more than a block is cut into blocks by page; each has its own
suffix array, and asks the others, by fingerprint, which of its shortest
substrings they have.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _exchange, _text
from ._common import cut

LEAST = 8
BLOCK_BYTES = 6 << 20
EXTRACTED = "page_id bigint, text string, n_tokens bigint, n_removed bigint"

_HIDDEN = {n: re.compile(rf"(?i)</{n}\s*>") for n in ("script", "style", "title", "noscript", "template", "svg", "iframe", "textarea")}
_BLOCKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr td th table article section nav header footer aside main blockquote pre form dd dt dl hr body".split())
#: Where markup begins, and how a tag goes on: neither side of a quote has a "<", so a failing match ends at the next one.
_MARK = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9]*)|[!?/])")
_REST = re.compile(r"""(?:[^'"<>]++|"[^"<]*+"|'[^'<]*+')*+>""")


def visible_text(page: str) -> str:
    """The text that a page shows: no scripts, styles, titles, comments or tags, a line for each block.

    A tag ends at the first ">" outside quotes, or, where a "<" or an open quote
    comes before it, at the first ">"; where none follows, there is no tag. Hidden elements and
    comments that aren't closed go to the end of the page; "/>" closes. Every
    character is looked at a bounded number of times.
    """
    out: list[str] = []
    pos = 0
    while m := _MARK.search(page, pos):
        out.append(page[pos : m.start()])
        if m[1]:
            end = page.find("-->", m.end())
            if end < 0:
                break
            out.append(" ")
            pos = end + 3
            continue
        rest = _REST.match(page, m.end())
        pos = rest.end() if rest else page.find(">", m.end()) + 1
        if not pos:  # no tag and no comment can end any more
            end = page.find("<!--", m.start())
            out.append(page[m.start() : end if end >= 0 else len(page)])
            break
        name = m[3].lower() if m[3] else ""
        if name in _BLOCKS:
            out.append("\n")
        elif name in _HIDDEN and not m[2] and page[pos - 2] != "/":
            close = _HIDDEN[name].search(page, pos)
            if close is None:
                break
            out.append(" ")
            pos = close.end()
    else:
        out.append(page[pos:])
    return "\n".join(x for x in (" ".join(line.split()) for line in html.unescape("".join(out)).split("\n")) if x)


def suffix_array(tokens: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes tokens[i : end[i]] in order, and the common prefix of each with the one before it (0 for the first).

    Prefix doubling; after the first round only suffixes that are still equal to
    others are sorted again, those that end equal stay together. The ranks of
    every depth are kept: they give the common prefixes by halving steps.
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, kind, many = np.unique(tokens, return_inverse=True, return_counts=True)
    order = np.argsort(kind, kind="stable")
    rank = (np.cumsum(many) - many)[kind]
    depths = [rank.astype(np.int32)]
    tied = np.flatnonzero(np.repeat(many > 1, many))  # places in order
    depth = 1
    while len(tied):
        p = order[tied]
        far = np.minimum(p + depth, n - 1)
        then = np.where(p + depth < end[p], rank[far], -1)
        o = np.lexsort((then, rank[p]))
        p, then = p[o], then[o]
        order[tied] = p
        same = rank[p]
        first = np.flatnonzero(np.concatenate([[True], (same[1:] != same[:-1]) | (then[1:] != then[:-1])]))
        size = np.diff(np.append(first, len(p)))
        rank = rank.copy()
        rank[p] = np.repeat(tied[first], size)
        depths.append(rank.astype(np.int32))
        tied = tied[np.repeat(size > 1, size) & (then >= 0)]
        depth *= 2
    a, b = order[:-1], order[1:]
    lcp = np.zeros(n - 1, np.int64)
    room = np.minimum(end[a] - a, end[b] - b)
    for k in range(len(depths) - 1, -1, -1):
        some = np.flatnonzero(lcp < room)
        at = lcp[some]
        some = some[depths[k][a[some] + at] == depths[k][b[some] + at]]
        lcp[some] = np.minimum(lcp[some] + (1 << k), room[some])
    return order, np.concatenate([[0], lcp])


def _lowest(lcp: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Of each place, the minimum of lcp from the start of its run; runs are numbered in order."""
    step = int(lcp.max(initial=0)) + 1
    return np.minimum.accumulate(lcp - run * step) + run * step


def longest_shared(tokens: np.ndarray, end: np.ndarray, page: np.ndarray) -> np.ndarray:
    """For each suffix the length of its longest prefix that stands on another page too."""
    order, lcp = suffix_array(tokens, end)
    if not len(order):
        return order
    on = page[order]
    run = np.concatenate([[0], np.cumsum(on[1:] != on[:-1])])  # neighbours of one page: the nearest of another is beyond
    up = _lowest(lcp, run)
    down = _lowest(np.append(lcp[1:], 0)[::-1], run[-1] - run[::-1])[::-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(up, down)
    return out


def _streams(docs: _exchange.Docs, least: int):
    """Token streams of a block: chunks, tokens of each page, tokens, page row of each, where windows begin, and whether the host is split."""
    hosts, split, texts = zip(*(p.split("\0", 2) for p in docs[1])) if docs[1] else ((), (), ())
    host = _text.span_hashes(*_spans([h.encode() for h in hosts]))
    chunks = list(_text.words(list(texts), lower=False))
    tokens = np.concatenate([w.hashes for w in chunks]) if chunks else np.zeros(0, np.uint64)
    count = np.concatenate([np.diff(w.ptr) for w in chunks]) if chunks else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(count)), count)
    tokens = _text.mix(tokens ^ host[doc])  # those of other hosts are others
    at = np.flatnonzero(np.arange(len(tokens)) + least <= np.cumsum(count)[doc])
    return chunks, count, tokens, doc, at, np.array([s == "1" for s in split], dtype=bool)


def _spans(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(p) for p in parts]).astype(np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), ends - np.array([len(p) for p in parts], np.int64), ends


def _fingerprints(tokens: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    w = _text.Words(0, np.array([0, len(tokens)]), tokens, at, at, b"")
    h, _ = _text.ngrams(w, least)
    return h[at] >> np.uint64(64 - _exchange.BITS) if len(at) else np.zeros(0, np.uint64)


def extract(pages: DataFrame, least: int = LEAST, block_bytes: int = BLOCK_BYTES, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, text, n_tokens, n_removed) of every page.

    A substring of `least` tokens that stands on at least two pages of a host
    is boilerplate; so is a longer one, being covered by such. text has the
    runs of other tokens, one a line, n_removed of n_tokens are gone. Tokens
    are words as in _text, but with their case. Pages are told apart by key:
    rows that repeat a key are one page to each other, and each has its row. A
    page whose url is null or has no host is compared with none. What is text
    is said in visible_text; malformed markup takes no longer. A null page
    or one without text has an empty text. Rows of a null key are left out.
    Only the three named columns are read.
    """
    rows = pages.where(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").cast("bigint").alias("k"),
        F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)).alias("h"),
        F.coalesce(F.col(f"`{page}`"), F.lit("")).alias("t"),
    )
    rows = rows.withColumn("h", F.when(F.col("h") == "", F.concat(F.lit("#"), F.col("k"))).otherwise(F.translate("h", "\0", " ")))
    sizes = cut(rows.groupBy("h").agg(F.sum(F.octet_length("t")).alias("size")))
    total, large = sizes.agg(F.sum("size"), F.count(F.when(F.col("size") > block_bytes, 1))).first()
    n = _exchange.block_count(total, block_bytes)
    split = sizes.where(F.col("size") > block_bytes).select("h", F.ceil(F.col("size") / block_bytes).cast("bigint").alias("s"))
    # only hosts larger than a block are in it; so many that they aren't small are joined by a shuffle
    rows = rows.join(F.broadcast(split) if large <= 100_000 else split, "h", "left")
    salt = F.when(F.col("s").isNotNull(), F.pmod(F.xxhash64("k"), F.col("s"))).otherwise(F.lit(0))
    block = F.pmod(F.xxhash64("h", salt), F.lit(n)).cast("int")
    marked = rows.select("k", F.concat_ws("\0", "h", F.when(F.col("s").isNotNull(), "1").otherwise("0"), "t").alias("t"), block.alias("block"))

    def prepare(t: str) -> str:
        h, s, body = t.split("\0", 2)
        return f"{h}\0{s}\0{visible_text(body)}"

    def emit(docs: _exchange.Docs) -> tuple[np.ndarray, np.ndarray]:
        some = [(k, t) for k, t in zip(*docs) if t.split("\0", 2)[1] == "1"]
        _, _, tokens, _, at, _ = _streams(([k for k, _ in some], [t for _, t in some]), least)
        f = np.unique(_fingerprints(tokens, at, least))
        return f, np.zeros(len(f), np.uint16)

    def reduce(f: np.ndarray, payload: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])) if len(f) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(f)))
        return np.repeat((size > 1).astype(np.uint32), size), np.arange(2, dtype=np.uint64)[:, None]

    arrow = pa.schema([("page_id", pa.int64()), ("text", pa.string()), ("n_tokens", pa.int64()), ("n_removed", pa.int64())])

    def finish(block: int, docs: _exchange.Docs, answers: np.ndarray) -> pa.Table:
        chunks, count, tokens, doc, at, is_split = _streams(docs, least)
        _, page = np.unique(docs[0], return_inverse=True)
        size = longest_shared(tokens, np.cumsum(count)[doc], page[doc])
        covers = [(np.flatnonzero(size >= least), size[size >= least])]
        if answers.size:
            ask = at[is_split[doc[at]]]
            f = _fingerprints(tokens, ask, least)
            found = ask[(answers[0] > 0)[np.searchsorted(np.unique(f), f)]]
            covers.append((found, np.full(len(found), least)))
        edge = np.zeros(len(tokens) + 1, dtype=np.int64)
        for begin, length in covers:
            edge[:-1] += np.bincount(begin, minlength=len(tokens))
            edge -= np.bincount(begin + length, minlength=len(edge))
        keep = np.cumsum(edge)[:-1] == 0
        texts, base = [], 0
        for w in chunks:
            for k in range(len(w.ptr) - 1):
                lo, hi = int(w.ptr[k]), int(w.ptr[k + 1])
                own = keep[base + lo : base + hi]
                step = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
                lines = []
                for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)):
                    # with the signs after a word, up to the next one
                    stop = w.starts[lo + b] if lo + b < hi else w.buf.find(b"\n", w.ends[lo + b - 1])
                    lines.append(w.buf[w.starts[lo + a] : stop].decode().strip())
                texts.append("\n".join(lines))
            base += int(w.ptr[-1])
        gone = np.bincount(doc, weights=~keep, minlength=len(count)).astype(np.int64) if len(count) else count
        return pa.Table.from_arrays([pa.array(docs[0], pa.int64()), pa.array(texts, pa.string()), pa.array(count, pa.int64()), pa.array(gone, pa.int64())], schema=arrow)

    return _exchange.detect(_exchange.pack_blocks(marked, n, prepare), emit, reduce, finish, EXTRACTED)
