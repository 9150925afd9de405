"""Toxicity: gradient-boosted trees over dense features, isotonic calibration (operator 5).

Features are densities of lexicon words (a seed list, and words and word
beginnings learnt from labelled rows), nearness of second-person words to
them, and rates of capitals, punctuation and obfuscation. The labelled sample
is split by hash: lexicon, trees and calibration each see rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._labelled import labelled

SAMPLE = 20_000
SEED_WORDS = (
    "idiot idiots moron morons stupid loser losers trash scum clown clowns pathetic worthless disgusting dumb dumbass "
    "imbecile jerk garbage filth vermin hate kill shut bastard freak ugly coward fool retard "
    "idiota imbécil estúpido basura asco dummkopf trottel abschaum arschloch widerlich "
    "imbécile connard salaud ordure débile minable"
).split()
YOU = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted tú ti vosotros".split()
PREFIXES = (4, 5)
NEAR = 5
FEATURES = 18
_LEET = str.maketrans("013457@$!", "oieastasi")


@dataclass
class Model:
    """Sorted lexicon hashes with weights; trees as arrays; calibration knots."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    word_weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    stems: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    stem_weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    base: float = 0.0
    trees: list = field(default_factory=list)
    knots: np.ndarray = field(default_factory=lambda: np.zeros((2, 1)))


_SEED = np.sort(np.array([_text.word_hash(w) for w in SEED_WORDS], dtype=np.uint64))
_YOU = np.sort(np.array([_text.word_hash(w) for w in YOU], dtype=np.uint64))


def stem_hashes(w: _text.Words) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, hash) of the first bytes of every longer word, for each length of PREFIXES."""
    a = np.frombuffer(w.buf, dtype=np.uint8)
    at, h = [], []
    for n in PREFIXES:
        i = np.flatnonzero(w.ends - w.starts > n)
        at.append(i)
        h.append(_text.span_hashes(a, w.starts[i], w.starts[i] + n) ^ np.uint64(n))
    return np.concatenate(at), np.concatenate(h)


def _inside(sorted_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index into sorted_, -1 where h isn't there."""
    if not len(sorted_):
        return np.full(len(h), -1)
    i = np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)
    return np.where(sorted_[i] == h, i, -1)


_KIND = np.zeros(256, dtype=np.uint8)
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[48:58] = 3
for _c in b"!?":
    _KIND[_c] = 4
for _c in b"*#$%&@^~|":
    _KIND[_c] = 5
for _c in b".,;:'\"()-":
    _KIND[_c] = 6


def features(texts: list[str | None], m: Model) -> np.ndarray:
    """[texts, FEATURES] as float32; a null or empty text has zeros."""
    out = np.zeros((len(texts), FEATURES), dtype=np.float32)
    for w in _text.words(texts):
        n = len(w.ptr) - 1
        o = out[w.first : w.first + n]
        count = np.diff(w.ptr)
        total = np.maximum(count, 1)
        doc = np.repeat(np.arange(n), count)

        def by_doc(i: np.ndarray, weight: np.ndarray | None = None, doc: np.ndarray = doc, n: int = n) -> np.ndarray:
            return np.bincount(doc[i], weights=weight, minlength=n)

        seed = np.flatnonzero(_inside(_SEED, w.hashes) >= 0)
        k = _inside(m.words, w.hashes)
        learnt = np.flatnonzero(k >= 0)
        at, h = stem_hashes(w)
        s = _inside(m.stems, h)
        some = np.flatnonzero(s >= 0)
        stem, first = np.unique(at[some], return_index=True)
        weight = m.stem_weight[s[some[first]]] if len(some) else np.zeros(0)
        hit = np.unique(np.concatenate([seed, learnt, stem]))
        o[:, 0], o[:, 1] = by_doc(seed), by_doc(seed) / total
        o[:, 2], o[:, 3] = by_doc(learnt), by_doc(learnt) / total
        o[:, 4] = by_doc(learnt, m.word_weight[k[learnt]]) if len(learnt) else 0
        o[:, 5], o[:, 6] = by_doc(stem), by_doc(stem) / total
        o[:, 7] = by_doc(stem, weight) if len(stem) else 0
        o[:, 8], o[:, 9] = by_doc(hit), by_doc(hit) / total
        you = np.flatnonzero(_inside(_YOU, w.hashes) >= 0)
        if len(you) and len(hit):
            i = np.searchsorted(you, hit)
            left, right = you[np.maximum(i - 1, 0)], you[np.minimum(i, len(you) - 1)]
            near = (np.abs(left - hit) <= NEAR) & (doc[left] == doc[hit]) | (np.abs(right - hit) <= NEAR) & (doc[right] == doc[hit])
            o[:, 10] = by_doc(hit[near])
        o[:, 11] = by_doc(you) / total
        o[:, 12] = np.log1p(count)
        _signs(texts[w.first : w.first + n], o)
    return out


def _signs(texts: list[str | None], o: np.ndarray) -> None:
    """Rates of letters and signs of a chunk of texts, into o[:, 13:]."""
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    a = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)  # a line end after each, so no text is without bytes
    size = np.array([len(r) for r in raw], dtype=np.int64)
    begin = np.cumsum(size + 1) - size - 1
    kind = _KIND[a]

    def count(hit: np.ndarray) -> np.ndarray:
        return np.add.reduceat(hit, begin, dtype=np.int64)

    letter = (kind == 1) | (kind == 2)
    inner, twice = np.zeros(len(a), dtype=bool), np.zeros(len(a), dtype=bool)
    # a sign or digit between two letters of one word
    inner[1:-1] = letter[:-2] & letter[2:] & ((kind[1:-1] == 3) | (kind[1:-1] == 5))
    twice[1:] = (a[1:] == a[:-1]) & (a[1:] != 32)
    twice[begin] = False
    twice[begin + size] = False
    length = np.maximum(size, 1)
    upper, letters = count(kind == 1), count(letter)
    o[:, 13], o[:, 14] = count(inner) / length, count(twice) / length
    o[:, 15] = upper / np.maximum(letters, 1)
    o[:, 16], o[:, 17] = count(kind == 4) / length, count(kind == 5) / length


def _lexicon(train: DataFrame, total: tuple[int, int], least: int, odds: float) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Words and word beginnings that toxic rows have and others don't: sorted hashes and log-odds.

    Each is in `least` rows of the sample, so the sample bounds their number.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            y = pdf["y"].to_numpy()
            parts = []
            for w in _text.words(pdf["t"].tolist()):
                doc = np.repeat(np.arange(len(w.ptr) - 1), np.diff(w.ptr)) + w.first
                at, h = stem_hashes(w)
                for kind, d, x in (("word", doc, w.hashes), ("stem", doc[at], h)):
                    if len(x):
                        o = np.lexsort((d, x))
                        new = np.ones(len(o), dtype=bool)
                        new[1:] = (x[o][1:] != x[o][:-1]) | (d[o][1:] != d[o][:-1])
                        x, d = x[o][new], d[o][new]
                        each, back = np.unique(x, return_inverse=True)
                        toxic = np.bincount(back, weights=y[d])
                        parts.append(pd.DataFrame({"kind": kind, "h": each.view(np.int64), "a": toxic.astype(np.int64), "c": (np.bincount(back) - toxic).astype(np.int64)}))
            if parts:
                yield pd.concat(parts)

    a, c = F.sum("a"), F.sum("c")
    t1, t0 = total
    score = F.log((F.col("a") + 0.5) / (t1 - F.col("a") + 0.5)) - F.log((F.col("c") + 0.5) / (t0 - F.col("c") + 0.5))
    best = (
        train.mapInPandas(count, "kind string, h bigint, a bigint, c bigint")
        .groupBy("kind", "h").agg(a.alias("a"), c.alias("c"))
        .where(F.col("a") >= least).withColumn("score", score).where(F.col("score") >= odds)
        .select("kind", "h", "score").toPandas()
    )
    out = {}
    for kind in ("word", "stem"):
        b = best[best["kind"] == kind]
        h = b["h"].to_numpy(np.int64).view(np.uint64)
        o = np.argsort(h)
        out[kind] = h[o], b["score"].to_numpy(float)[o]
    return out


def _boost(x: np.ndarray, y: np.ndarray, rounds: int, depth: int, rate: float, bins: int = 32, ridge: float = 1.0, least: float = 1.0) -> tuple[float, list]:
    """Newton boosting of the logistic loss on binned features; a tree is (feature, threshold, value) in heap order."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # code <= i where x <= edges[i]
    p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    f = np.full(len(y), base)
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)
        size = 2 ** (depth + 1)
        feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.ones(len(y), dtype=np.int64)
        for d in range(depth):
            lo, n = 2**d, 2**d
            live = node >= lo
            gain_best, split = np.zeros(n), np.zeros((n, 2), dtype=np.int64)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                w = len(e) + 1
                flat = (node[live] - lo) * w + code[live, j]
                gs = np.bincount(flat, g[live], minlength=n * w).reshape(n, w).cumsum(axis=1)
                hs = np.bincount(flat, h[live], minlength=n * w).reshape(n, w).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gl, hl, gr, hr = gs[:, :-1], hs[:, :-1], gt - gs[:, :-1], ht - hs[:, :-1]
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gt**2 / (ht + ridge)
                gain[(hl < least) | (hr < least)] = 0
                i = gain.argmax(axis=1)
                better = gain[np.arange(n), i] > gain_best + 1e-9
                gain_best[better] = gain[np.arange(n), i][better]
                split[better] = np.stack([np.full(n, j), i], axis=1)[better]
            at = np.flatnonzero(live & (gain_best[np.maximum(node - lo, 0) % n] > 0))
            for k in np.flatnonzero(gain_best > 0):
                feature[lo + k], threshold[lo + k] = split[k, 0], edges[split[k, 0]][split[k, 1]]
            k = node[at] - lo
            node[at] = 2 * node[at] + (code[at, split[k, 0]] > split[k, 1])
        gs, hs = np.bincount(node, g, minlength=size), np.bincount(node, h, minlength=size)
        value = -rate * gs / (hs + ridge)
        f += value[node]
        trees.append((feature, threshold, value))
    return base, trees


def raw_scores(x: np.ndarray, m: Model) -> np.ndarray:
    f = np.full(len(x), m.base)
    rows = np.arange(len(x))
    for feature, threshold, value in m.trees:
        node = np.ones(len(x), dtype=np.int64)
        while True:
            j = feature[node]
            go = j >= 0
            if not go.any():
                break
            node = np.where(go, 2 * node + (x[rows, np.maximum(j, 0)] > threshold[node]), node)
        f += value[node]
    return f


def isotonic(score: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: [scores, probabilities] of the knots, rising."""
    o = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, lowest, highest score
    for s, v in zip(score[o], y[o]):
        blocks.append([float(v), 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            n = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / n, n, a[2], b[3]])
    return np.array([[x for b in blocks for x in (b[2], b[3])], [b[0] for b in blocks for _ in (0, 1)]])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = 60, depth: int = 3, rate: float = 0.2, odds: float = 3.0, key: str = "doc_id", text: str = "text") -> Model:
    """Fit on at most `sample` labelled rows (column toxic); without both labels the model is constant 0.

    The lexicon has every word and beginning with log-odds of `odds` in the sample.
    """
    rows = labelled(docs, labels, "toxic", sample, key, text)
    part = F.pmod(F.xxhash64("k", F.lit("split")), F.lit(10))
    train = rows.where(part < 5)
    sums = train.agg(F.sum("y"), F.count("*")).first()
    toxic, count = int(sums[0] or 0), int(sums[1])
    m = Model()
    if toxic:
        lex = _lexicon(train, (toxic, count - toxic), max(3, round(0.004 * toxic)), odds)
        (m.words, m.word_weight), (m.stems, m.stem_weight) = lex["word"], lex["stem"]
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = features(pdf["t"].tolist(), shared.value)
            yield pd.DataFrame({"k": pdf["k"], "y": pdf["y"], "p": pdf["p"], "x": list(x)})

    rest = rows.withColumn("p", part).where(part >= 5).mapInPandas(of, "k bigint, y int, p bigint, x array<float>").toPandas()
    rest = rest.sort_values("k", kind="stable")
    x = np.stack(rest["x"]).astype(np.float32) if len(rest) else np.zeros((0, FEATURES), np.float32)
    y, p = rest["y"].to_numpy(float), rest["p"].to_numpy()
    fit_on, tune = p < 8, p >= 8
    if not 0 < y[fit_on].sum() < fit_on.sum():
        return m
    m.base, m.trees = _boost(x[fit_on], y[fit_on], rounds, depth, rate)
    some = tune if 0 < y[tune].sum() < tune.sum() else np.ones(len(y), dtype=bool)
    m.knots = isotonic(raw_scores(x[some], m), y[some])
    return m


def score(text: Column, m: Model, spark) -> Column:
    """Calibrated probability that a text is toxic; null for null."""
    shared = spark.sparkContext.broadcast(m)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for t in batches:
            texts = t.tolist()
            p = np.interp(raw_scores(features(texts, m), m), m.knots[0], m.knots[1]) if m.trees else np.zeros(len(texts))
            yield pd.Series(p).where(t.notna().reset_index(drop=True))

    return run(text)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, toxicity, toxic) of every row of docs: probability to six places, and 1 where it reaches the threshold.

    A null text has a null probability and isn't toxic; an empty one is scored
    as a text without words. Keys are passed through, null or repeated; equal
    texts get equal scores. Without labels of both kinds nothing is toxic.
    Only the two named columns are read.
    """
    m = fit(docs, labels, key=key, text=text, **options)
    p = F.round(score(F.col(f"`{text}`"), m, docs.sparkSession), 6)
    return docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), p.alias("toxicity")).withColumn("toxic", F.coalesce((F.col("toxicity") >= threshold).cast("int"), F.lit(0)))
