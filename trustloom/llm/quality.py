"""Quality classifier: Naive Bayes support vectors (operator 4).

Indicators of word 1- and 2-grams are scaled by the log ratio of their counts
in the two classes; a linear hinge-loss model over them is fitted by dual
coordinate descent and mixed with the mean weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._labelled import labelled

SAMPLE = 10_000
ORDERS = (1, 2)


@dataclass
class Model:
    """Sorted n-gram hashes, their weights (class ratio times model), and the bias."""

    grams: np.ndarray
    weights: np.ndarray
    bias: float


def indicators(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, n-gram hash) of all places, chunk by chunk."""
    for w in _text.words(texts):
        for n in ORDERS:
            h, ptr = _text.ngrams(w, n)
            yield np.repeat(np.arange(len(ptr) - 1) + w.first, np.diff(ptr)), h


def _hits(texts: list[str | None], grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, number of the n-gram) of those that grams has, sorted."""
    out = []
    for doc, h in indicators(texts):
        if len(grams) and len(h):
            i = np.minimum(np.searchsorted(grams, h), len(grams) - 1)
            ok = grams[i] == h
            out.append(np.unique(doc[ok].astype(np.int64) << 32 | i[ok]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.concatenate(out))
    return both >> 32, both & 0xFFFFFFFF


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 0) -> tuple[np.ndarray, float]:
    """w and bias of min |w|^2 / 2 + sum cost * hinge over rows of indicators scaled by ratio; y is -1 or 1."""
    w, bias = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([np.sum(ratio[r] ** 2) for r in rows]) + 1.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            x = ratio[r]
            gradient = y[i] * (w[r] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[r] += step * x
                bias += step
                moved = max(moved, abs(gradient))
        if moved < 1e-2:
            break
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: int = 3, c: float = 0.1, smooth: float = 1.0, mixed: float = 0.25, epochs: int = 15, key: str = "doc_id", text: str = "text") -> Model:
    """Fit on at most `sample` labelled rows (column quality); with one class only, that class is always the answer.

    An n-gram counts if at least `least` rows of the sample have it. Hinge loss
    is weighted so that the classes count alike.
    """
    rows = labelled(docs, labels, "quality", sample, key, text)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            y = pdf["y"].to_numpy()
            for doc, h in indicators(pdf["t"].tolist()):
                if not len(h):
                    continue
                o = np.lexsort((doc, h))
                h, doc = h[o], doc[o]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                each, back = np.unique(h[new], return_inverse=True)
                good = np.bincount(back, weights=y[doc[new]]).astype(np.int64)
                yield pd.DataFrame({"h": each.view(np.int64), "a": good, "b": np.bincount(back) - good})

    counts = rows.mapInPandas(count, "h bigint, a bigint, b bigint").groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") + F.col("b") >= least).toPandas()
    counts["h"] = counts["h"].to_numpy(np.int64).view(np.uint64)
    counts = counts.sort_values("h")
    grams = counts["h"].to_numpy(np.uint64)
    p, q = counts["a"].to_numpy(float) + smooth, counts["b"].to_numpy(float) + smooth
    ratio = np.log((p / p.sum()) / (q / q.sum())) if len(grams) else np.zeros(0)
    shared = docs.sparkSession.sparkContext.broadcast(grams)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            doc, gram = _hits(pdf["t"].tolist(), shared.value)
            cuts = np.searchsorted(doc, np.arange(len(pdf) + 1))
            g = gram.astype(np.int32)
            yield pd.DataFrame({"k": pdf["k"], "y": pdf["y"], "x": [g[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]})

    data = rows.mapInPandas(of, "k bigint, y int, x binary").toPandas().sort_values("k", kind="stable")
    y = np.where(data["y"].to_numpy() == 1, 1.0, -1.0)
    good = int((y > 0).sum())
    if not 0 < good < len(y):
        return Model(np.zeros(0, np.uint64), np.zeros(0), 1.0 if good or not len(y) else -1.0)
    cost = np.where(y > 0, c * len(y) / (2 * good), c * len(y) / (2 * (len(y) - good)))
    w, bias = dual_coordinate_descent([np.frombuffer(x, np.int32) for x in data["x"]], y, ratio, cost, epochs)
    w = (1 - mixed) * np.abs(w).mean() + mixed * w
    keep = ratio * w != 0
    return Model(grams[keep], (ratio * w)[keep], mixed * bias)


def score(text: Column, m: Model, spark) -> Column:
    """The model's margin for each text; null for null."""
    shared = spark.sparkContext.broadcast(m)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for t in batches:
            doc, gram = _hits(t.tolist(), m.grams)
            s = np.bincount(doc, weights=m.weights[gram], minlength=len(t)) + m.bias if len(t) else np.zeros(0)
            yield pd.Series(s).where(t.notna().reset_index(drop=True))

    return run(text)


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, margin, quality) of every row of docs: margin to four places, and 1 where it isn't negative.

    A null text has a null margin and quality 0; an empty one has the bias for
    margin. Keys are passed through, null or repeated; equal texts get equal
    margins. Only the two named columns are read.
    """
    m = fit(docs, labels, key=key, text=text, **options)
    s = F.round(score(F.col(f"`{text}`"), m, docs.sparkSession), 4)
    return docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), s.alias("margin")).withColumn("quality", F.coalesce((F.col("margin") >= 0).cast("int"), F.lit(0)))
