"""Benchmark decontamination with a positional inverted index (operator 10).

The training documents are indexed in shards: for every term of the benchmark,
the sorted positions at which the shard has it. A phrase is answered by taking
the postings of its globally rarest term, shifting them by the term's offset,
and intersecting with the other terms' postings in order of rarity, for all
phrases of a shard at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common, _text

NGRAM, SLOP, MIN_TERMS = 8, 2, 5
#: Positions of one document and the next are this far apart, so that no match spans two.
GAP = 1 << 10
_POS_BITS = 40
INDEX = "doc_ids binary, doc_starts binary, terms binary, counts binary, postings binary"
FOUND = "doc_id bigint, item_id bigint, exact_hits bigint, near_hits bigint"


def _phrases(items: list[tuple[int, str | None]], n: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: term hashes [phrases, length] and the item of each phrase."""
    found: dict[int, tuple[list, list]] = {}
    for w in _text.words([t for _, t in items]):
        for k in range(len(w.ptr) - 1):
            h = w.hashes[w.ptr[k] : w.ptr[k + 1]]
            size = min(n, len(h))
            if size < MIN_TERMS:
                continue
            win = np.unique(np.lib.stride_tricks.sliding_window_view(h, size), axis=0)
            a, b = found.setdefault(size, ([], []))
            a.append(win)
            b.append(np.full(len(win), items[w.first + k][0], dtype=np.int64))
    return {s: (np.concatenate(a), np.concatenate(b)) for s, (a, b) in found.items()}


def build_index(docs: DataFrame, terms: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards of the positional index of docs over the sorted term hashes."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(terms)

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = shared.value
        for pdf in batches:
            at, pos, base = [], [], GAP
            starts = np.zeros(len(pdf), dtype=np.int64)
            for w in _text.words(pdf["t"].tolist()):
                count = np.diff(w.ptr)
                begin = base + np.concatenate([[0], np.cumsum(count + GAP)])
                starts[w.first : w.first + len(count)] = begin[:-1]
                base = begin[-1]
                t = np.searchsorted(vocab, w.hashes)
                t[t == len(vocab)] = 0
                hit = np.flatnonzero(vocab[t] == w.hashes)
                at.append(t[hit])
                own = np.searchsorted(w.ptr, hit, side="right") - 1
                pos.append(begin[own] + hit - w.ptr[own])
            keys = np.sort((np.concatenate(at).astype(np.int64) << _POS_BITS) | np.concatenate(pos)) if at else np.zeros(0, np.int64)
            ids, n = np.unique(keys >> _POS_BITS, return_counts=True)
            delta = np.diff(keys, prepend=0).astype("<i8")
            blob = zstandard.ZstdCompressor(level=1).compress(delta.view(np.uint8).reshape(-1, 8).T.tobytes())
            yield pd.DataFrame([{"doc_ids": pdf["k"].to_numpy(np.int64).tobytes(), "doc_starts": starts.tobytes(), "terms": ids.tobytes(), "counts": n.astype(np.int64).tobytes(), "postings": blob}])

    return docs.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{text}`").alias("t")).mapInPandas(shards, INDEX)


def _postings(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel())


def _match(keys: np.ndarray, grid: np.ndarray, order: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, start) of all matches whose every term lies within slop of its place.

    keys: sorted term << bits | position. grid: term numbers [phrases, length].
    order: the columns of each phrase by rarity.
    """
    rows = np.arange(len(grid))
    rare = grid[rows, order[:, 0]]
    lo = np.searchsorted(keys, rare << _POS_BITS)
    count = np.searchsorted(keys, (rare + 1) << _POS_BITS) - lo
    at, phrase = _text.ragged(lo, count)
    start = (keys[at] & ((1 << _POS_BITS) - 1)) - order[phrase, 0]
    if slop:
        phrase = np.repeat(phrase, 2 * slop + 1)
        start = (start[:, None] + np.arange(-slop, slop + 1)).ravel()
    for k in range(1, grid.shape[1]):
        if not len(phrase):
            break
        col = order[phrase, k]
        want = (grid[phrase, col] << _POS_BITS) | (start + col)
        i = np.searchsorted(keys, want - slop)
        ok = keys[np.minimum(i, len(keys) - 1)] <= want + slop
        ok &= i < len(keys)
        phrase, start = phrase[ok], start[ok]
    if slop and len(phrase):
        both = np.unique(np.stack([phrase, start]), axis=1)
        phrase, start = both[0], both[1]
    return phrase, start


def search(index: DataFrame, terms: np.ndarray, phrases: dict, slop: int) -> DataFrame:
    """Matches of the phrases in an index, by document and item."""
    spark = index.sparkSession

    def df_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(terms), dtype=np.int64)
        for pdf in batches:
            for t, c in zip(pdf["terms"], pdf["counts"]):
                total[np.frombuffer(t, np.int64)] += np.frombuffer(c, np.int64)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"term": some, "n": total[some]})

    freq = np.zeros(len(terms), dtype=np.int64)
    for term, n in index.select("terms", "counts").mapInPandas(df_of, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect():
        freq[term] = n  # at most one row a term of the benchmark
    plan = []
    for size, (hashes, item) in phrases.items():
        grid = np.searchsorted(terms, hashes).astype(np.int64)
        live = (freq[grid] > 0).all(axis=1)
        grid = grid[live]
        plan.append((grid, np.argsort(freq[grid], axis=1, kind="stable"), item[live]))
    shared = spark.sparkContext.broadcast(plan)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                keys = _postings(row.postings)
                ids, begin = np.frombuffer(row.doc_ids, np.int64), np.frombuffer(row.doc_starts, np.int64)
                out = []
                for grid, order, item in shared.value:
                    for kind, s in (("exact_hits", 0), ("near_hits", slop)):
                        phrase, start = _match(keys, grid, order, s) if len(keys) and len(grid) else (np.zeros(0, np.int64),) * 2
                        doc = np.searchsorted(begin, start + (GAP // 2 if s else 0), side="right") - 1
                        out.append(pd.DataFrame({"doc_id": ids[np.maximum(doc, 0)], "item_id": item[phrase], "what": kind}))
                all_ = pd.concat(out)
                n = all_.groupby(["doc_id", "item_id", "what"]).size().unstack("what", fill_value=0)
                yield n.reindex(columns=["exact_hits", "near_hits"], fill_value=0).reset_index()[["doc_id", "item_id", "exact_hits", "near_hits"]]

    return index.select("doc_ids", "doc_starts", "postings").mapInPandas(find, FOUND).groupBy("doc_id", "item_id").agg(F.sum("exact_hits").alias("exact_hits"), F.sum("near_hits").alias("near_hits"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, slop: int = SLOP, key: str = "doc_id", text: str = "text", chunk_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, item_id, exact_hits, near_hits) of the documents that hold passages of items.

    A phrase is a distinct n-word window of an item, or the whole of an item of
    MIN_TERMS to n - 1 words; shorter items have none. exact_hits counts the
    places where a phrase occurs word for word. near_hits counts (phrase, start)
    such that every word of the phrase occurs within slop words of where start
    puts it (start itself may lie up to slop words before the document); exact
    places count there too. Case and punctuation don't matter.

    Null or empty texts on either side match nothing; documents of a null key
    and items of a null item_id are not reported. Repeated rows of a key count
    together. Only the two named columns of docs are read, so that other
    columns may have any name. Benchmarks above chunk_bytes of text are matched
    in that many parts, each against its own index.
    """
    if n + 2 * slop >= GAP // 2:
        raise ValueError(f"n + 2 * slop must be less than {GAP // 2}")
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // chunk_bytes) or 1
    out = docs.sparkSession.createDataFrame([], FOUND)
    for p in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p) if parts > 1 else items
        phrases = _phrases([(int(a), b) for a, b in mine.collect()], n)
        if not phrases:
            continue
        terms = np.unique(np.concatenate([h.ravel() for h, _ in phrases.values()]))
        index = _common.cut(build_index(docs, terms, key, text))
        found = search(index, terms, phrases, slop)
        out = out.unionAll(found) if p else found
    return out


SQL = rf"""
WITH p AS (SELECT doc_id, regexp_extract_all(lower(text), '{_text.WORD_SQL}') AS w FROM documents),
tok AS (SELECT doc_id, i AS pos, w[i] AS term FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM p)),
b AS (SELECT item_id, regexp_extract_all(lower(text), '{_text.WORD_SQL}') AS w FROM benchmark),
ph AS (SELECT DISTINCT item_id, w[i:i + least({NGRAM}, len(w)) - 1] AS g FROM
  (SELECT item_id, w, unnest(range(1, len(w) - least({NGRAM}, len(w)) + 2)) AS i FROM b WHERE len(w) >= {MIN_TERMS})),
pid AS (SELECT row_number() OVER () AS id, item_id, g FROM ph),
pt AS (SELECT id, item_id, len(g) AS size, k, g[k] AS term FROM (SELECT id, item_id, g, unnest(range(1, len(g) + 1)) AS k FROM pid)),
freq AS (SELECT term, count(*) AS n FROM tok GROUP BY term),
anchor AS (SELECT id, item_id, size, k, term FROM (SELECT pt.*, row_number() OVER (PARTITION BY id ORDER BY n, k) AS r FROM pt JOIN freq USING (term)) WHERE r = 1),
cand AS (SELECT DISTINCT id, item_id, size, doc_id, pos - k + d AS s FROM anchor JOIN tok USING (term), (SELECT unnest(range(-{SLOP}, {SLOP} + 1)) AS d)),
hit AS (SELECT c.id, c.item_id, c.doc_id, c.s, c.size, count(DISTINCT pt.k) AS near, count(DISTINCT CASE WHEN tok.pos = c.s + pt.k THEN pt.k END) AS exact
  FROM cand c JOIN pt ON pt.id = c.id JOIN tok ON tok.doc_id = c.doc_id AND tok.term = pt.term AND abs(tok.pos - (c.s + pt.k)) <= {SLOP} GROUP BY ALL)
SELECT doc_id, item_id, CAST(sum(CASE WHEN exact = size THEN 1 ELSE 0 END) AS BIGINT) AS exact_hits, count(*) AS near_hits
FROM hit WHERE near = size GROUP BY doc_id, item_id
"""
