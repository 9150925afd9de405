"""LM scoring: a log-bilinear model trained with noise-contrastive estimation (operator 2).

The vocabulary is every word of the corpus, however rare; its counts are taken
over all documents. The HEAD most frequent words and classes of the others make
one softmax. The next CLASSES * WIDTH words have vectors of their own too, and a
second softmax over their class. The rest of the words are in TAIL classes by
hash, where a word has the share of its count; those of the KNOWN most frequent
words are exact, the rarer words of a class share their total equally. So
probabilities are exactly normalised over all words of the corpus, and what a
worker holds is bounded whatever the corpus has.

Documents are cut into blocks by a hash. A first model comes from one block;
from it every block trains its own on all its words, and the parameters are
averaged level by level. Nothing depends on how the table was partitioned.
Scores come from batched matrix products of parameters rounded to 1/256, whose
sums are exact, so equal texts have equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _exchange, _text
from ._common import cut

#: TAIL is a power of two.
HEAD, CLASSES, WIDTH, TAIL, KNOWN = 96, 128, 256, 32, 1 << 20
#: A row has one number more than dimensions: a bias, which meets a 1.
DIMENSION, CONTEXT = 15, 2
NOISE, CLASS_NOISE, BATCH, RATE = 24, 2, 2048, 0.3
#: Bytes of text of a block; blocks averaged together; rows of parameters in a range; words scored together.
BLOCK_BYTES, FAN, SPAN, SCORED = 32 << 20, 32, 1024, 1 << 20
_ROWS = 512
_TRAINED = "part int, shard bigint, n binary, at binary, x binary"


@dataclass
class Vocabulary:
    """words: sorted hashes of the known words; number: of head and body words by frequency, then of the tail class.

    share: log of what a word has of its tail class, 0 for others; rare: that of
    a word not in words, by tail class. noise: probabilities of head words, body
    classes and tail classes; inside: of a body word in its class.
    """

    words: np.ndarray
    number: np.ndarray
    share: np.ndarray
    rare: np.ndarray
    noise: np.ndarray
    inside: np.ndarray
    head: int
    width: int

    def __post_init__(self):
        self.body = len(self.inside)
        self.classes = -(-self.body // self.width)
        self.tail = len(self.rare)
        self.start = self.head + self.body + self.tail  # the number of the place before a document
        self.shift = np.uint64(64 - max(1, min(20, int(len(self.words)).bit_length())))
        firsts = np.arange((1 << (64 - int(self.shift))), dtype=np.uint64) << self.shift
        self.index = np.searchsorted(self.words, firsts).astype(np.int32)
        self.ended = np.append(self.words, np.uint64((1 << 64) - 1))

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words, and the logs of their shares."""
        i = self.index[(h >> self.shift).astype(np.int64)]
        late = np.flatnonzero(self.ended[i] < h)
        while len(late):
            i[late] += 1
            late = late[self.ended[i[late]] < h[late]]
        known = self.ended[i] == h
        known &= i < len(self.words)
        kind = (h & np.uint64(self.tail - 1)).astype(np.int64)
        i = np.minimum(i, max(len(self.words) - 1, 0))
        number, share = self.head + self.body + kind, self.rare[kind]
        if len(self.words):
            number, share = np.where(known, self.number[i], number), np.where(known, self.share[i], share)
        return number, share

    def slot(self, w: np.ndarray) -> np.ndarray:
        """Of the first softmax: a head word's own, a class's, a tail class's."""
        inner = w - self.head
        return np.where(inner < 0, w, self.head + np.where(inner < self.body, inner // self.width, self.classes + inner - self.body))


@dataclass
class Model:
    """Scores are (c1*r[w1] + c2*r[w2], 1) @ q[slot]; q2 is that of body words in their classes. The last of r counts for nothing."""

    v: Vocabulary
    r: np.ndarray
    q: np.ndarray
    q2: np.ndarray
    c: np.ndarray

    @staticmethod
    def first(v: Vocabulary) -> Model:
        rng = np.random.default_rng(0)
        some = lambda n: rng.standard_normal((n, DIMENSION + 1), np.float32) * np.float32(0.1)
        m = Model(v, some(v.start + 1), some(len(v.noise)), some(v.body), np.ones((CONTEXT, DIMENSION + 1), np.float32))
        m.q[:, -1], m.q2[:, -1] = (np.log(np.maximum(p, 1e-12)) for p in (v.noise, v.inside))
        return m

    def parts(self) -> list[np.ndarray]:
        return [self.r, self.q, self.q2, self.c]

    def copy(self) -> Model:
        return Model(self.v, *(x.copy() for x in self.parts()))

    def hidden(self, w1: np.ndarray, w2: np.ndarray) -> np.ndarray:
        h = self.c[0] * self.r[w1]
        h += self.c[1] * self.r[w2]
        h[:, -1] = 1
        return h

    def log_prob(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray, share: np.ndarray) -> np.ndarray:
        """log P(word | w2 w1), w1 the nearer word, share as from find()."""
        out = share.astype(np.float64)
        out += self._softmax(w1, w2, self.v.slot(w), self.q)
        inner = w - self.v.head
        body = np.flatnonzero((inner >= 0) & (inner < self.v.body))
        kind = inner[body] // self.v.width
        body = body[np.argsort(kind, kind="stable")]
        edge = np.searchsorted(inner[body] // self.v.width, np.arange(self.v.classes + 1))
        for k, (a, e) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
            if a < e:
                i, lo = body[a:e], k * self.v.width
                hi = min(lo + self.v.width, self.v.body)
                out[i] += self._softmax(w1[i], w2[i], inner[i] - lo, self.q2[lo:hi])
        return out

    def _softmax(self, w1: np.ndarray, w2: np.ndarray, slot: np.ndarray, q: np.ndarray) -> np.ndarray:
        # multiples of 1/256 have sums of products below 256 that are exact, in whatever order they are added
        rows = _ROWS
        q = np.rint(q * 256) / np.float32(256)
        length = float(np.sqrt((q * q).sum(axis=1).max()))
        more = -len(q) % 32
        q = np.vstack([q, np.zeros((more, DIMENSION + 1), np.float32)])
        q[len(q) - more :, -1] = -1e9
        q = q.T.copy()
        out = np.empty(len(slot))
        hidden = np.zeros((rows, DIMENSION + 1), np.float32)
        lane = np.arange(rows)
        for lo in range(0, len(slot), rows):
            n = min(rows, len(slot) - lo)
            h = self.hidden(w1[lo : lo + n], w2[lo : lo + n])
            h *= 256
            np.rint(h, out=h)
            hidden[:n] = h / np.float32(256)
            s = hidden @ q
            if float(np.sqrt((hidden * hidden).sum(axis=1).max())) * length > 80:
                np.minimum(s, 80, out=s)
            own = s[lane[:n], slot[lo : lo + n]].astype(np.float64)
            np.exp(s, out=s)
            out[lo : lo + n] = own - np.log(s.sum(axis=1)[:n])
        return out


def contexts(v: Vocabulary, texts: list[str | None]) -> Iterator[tuple[np.ndarray, ...]]:
    """Per chunk: document, word before, word before that, word, log of its share."""
    for w in _text.words(texts):
        ids, share = v.find(w.hashes)
        count = np.diff(w.ptr)
        w1, w2 = np.roll(ids, 1), np.roll(ids, 2)
        some = w.ptr[:-1][count > 0]
        w1[some] = v.start
        w2[some] = v.start
        w2[w.ptr[:-1][count > 1] + 1] = v.start
        yield np.repeat(np.arange(len(count)) + w.first, count), w1, w2, ids, share


def _summed(i: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and the sums of their gradients."""
    o = np.argsort(i.astype(np.uint16) if int(i.max()) < 1 << 16 else i, kind="stable")
    i = i[o]
    start = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    return i[start], np.add.reduceat(g[o].view(np.complex64), start, axis=0).view(np.float32)  # two numbers at a time


def _pull(s: np.ndarray) -> np.ndarray:
    """d loss / d score of what was there."""
    return -1 / (1 + np.exp(np.clip(s, -30, 30)))


def _push(s: np.ndarray) -> np.ndarray:
    """d loss / d score of noise."""
    s = np.clip(s, -30, 30)
    np.negative(s, out=s)
    np.exp(s, out=s)
    s += 1
    return np.reciprocal(s, out=s)


class Trainer:
    """Adagrad on the NCE loss. A batch shares its noise slots, drawn from the corpus; a body word has noise words of its class."""

    def __init__(self, m: Model, rate: float, seed: int):
        self.m, self.rate, self.rng, v = m, np.float32(rate), np.random.default_rng(seed), m.v
        self.cumulative = np.cumsum(v.noise)
        self.inside = np.cumsum(v.inside)  # of class k: from k to k + 1
        log = lambda p, k: (np.log(np.maximum(p, 1e-12)) + np.log(k)).astype(np.float32)
        self.log_noise, self.log_inside = log(v.noise, NOISE), log(v.inside, CLASS_NOISE)
        self.square = [np.full_like(x, 1.0) for x in m.parts()]
        self.used = [np.zeros(len(m.r), bool), np.zeros(v.body, bool)]
        self.seen = 0

    def _apply(self, k: int, i: np.ndarray | slice, g: np.ndarray) -> None:
        x, square = self.m.parts()[k], self.square[k]
        s = g * g
        s += square[i]
        square[i] = s
        np.sqrt(s, out=s)
        g *= self.rate
        g /= s
        x[i] -= g

    def gradients(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray, noise: np.ndarray, at: np.ndarray) -> list[tuple]:
        """Of the loss of a batch, as (part of the model, rows, values); noise: slots; at: [body words, CLASS_NOISE] words."""
        m, v = self.m, self.m.v
        slot = v.slot(w)
        r1, r2, qw, qn = m.r[w1], m.r[w2], m.q[slot], m.q[noise]
        h = m.c[0] * r1
        h += m.c[1] * r2
        h[:, -1] = 1
        up = np.einsum("ij,ij->i", h, qw) - self.log_noise[slot]
        down = h @ qn.T
        down -= self.log_noise[noise]
        gu, gd = _pull(up), _push(down)
        gh = gu[:, None] * qw
        gh += gd @ qn
        out = [(1, *_summed(np.concatenate([slot, noise]), np.concatenate([gu[:, None] * h, gd.T @ h])))]
        body = np.flatnonzero((w >= v.head) & (w < v.head + v.body))
        if len(body):
            x, hb = w[body] - v.head, h[body]
            every = np.concatenate([x[:, None], at], axis=1)
            q = m.q2[every]
            s = (q @ hb[:, :, None])[:, :, 0] - self.log_inside[every]
            g = _push(s)
            g[:, 0] = _pull(s[:, 0])
            gh[body] += (g[:, None, :] @ q)[:, 0]
            out.append((2, *_summed(every.ravel(), (g[:, :, None] * hb[:, None, :]).reshape(-1, DIMENSION + 1))))
        gh[:, -1] = 0
        out.append((0, *_summed(np.concatenate([w1, w2]), np.concatenate([m.c[0] * gh, m.c[1] * gh]))))
        out.append((3, slice(None), np.stack([(gh * r1).sum(axis=0), (gh * r2).sum(axis=0)]) / np.float32(len(w))))
        return out

    def step(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray) -> None:
        v = self.m.v
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE) * self.cumulative[-1]), len(v.noise) - 1)
        x = w[(w >= v.head) & (w < v.head + v.body)] - v.head
        kind = x // v.width
        at = np.searchsorted(self.inside, kind[:, None] + self.rng.random((len(x), CLASS_NOISE)), side="right")
        lo = (kind * v.width)[:, None]
        at = np.clip(at, lo, np.minimum(lo + v.width, v.body) - 1)
        for k, i, g in self.gradients(w1, w2, w, noise, at):
            self._apply(k, i, g)
            if k in (0, 2):
                self.used[k // 2][i] = True
        self.seen += len(w)

    def run(self, texts: list[str]) -> Trainer:
        for _, w1, w2, w, _ in contexts(self.m.v, texts):
            mixed = self.rng.permutation(len(w))
            for lo in range(0, len(w), BATCH):
                i = mixed[lo : lo + BATCH]
                self.step(w1[i], w2[i], w[i])
        return self

    def trained(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(range, rows, their values) of the parameters that changed: -1 is c, even ranges are of r, odd ones of q2; -2 of q."""
        m = self.m
        yield -1, np.arange(CONTEXT), m.c
        yield -2, np.arange(len(m.q)), m.q
        for k, x in enumerate((m.r, m.q2)):
            i = np.flatnonzero(self.used[k])
            for part in np.split(i, np.flatnonzero(np.diff(i // SPAN)) + 1) if len(i) else []:
                yield 2 * (int(part[0]) // SPAN) + k, part, x[part]


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(h, n): every word of the corpus and how often it occurs."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h = [w.hashes for w in _text.words(pdf["t"].tolist())]
            each, n = np.unique(np.concatenate(h) if h else np.zeros(0, np.uint64), return_counts=True)
            yield pd.DataFrame({"h": each.view(np.int64), "n": n.astype(np.int64)})

    return docs.select(F.col(f"`{text}`").alias("t")).where("t is not null").mapInPandas(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, text: str = "text", head: int = HEAD, classes: int = CLASSES, width: int = WIDTH, known: int = KNOWN) -> Vocabulary:
    """The words of the corpus with their counts: at most `known` of them one by one, the others by tail class."""
    counts = cut(word_counts(docs, text))
    # counts from 4096 on by sixteenths of a power of two, so that the driver gets a few thousand rows
    level = F.when(F.col("n") < 4096, F.col("n").cast("double")).otherwise(F.floor(F.log2("n") * 16) + 4096)
    sizes = sorted(((r["l"], r["m"]) for r in counts.groupBy(level.alias("l")).agg(F.count("*").alias("m")).collect()), reverse=True)
    least, have = float("inf"), 0
    for at, m in sizes:
        have += m
        if have > known:
            break
        least = at
    rows = counts.where(level >= least).toArrow()
    h, n = rows["h"].to_numpy().astype(np.int64).view(np.uint64), rows["n"].to_numpy().astype(np.int64)
    order = np.lexsort((h, -n))
    h, n = h[order], n[order]
    head = min(head, len(h))
    body = max(0, min(classes * width, len(h) - head))
    width = max(1, -(-body // max(classes, 1)))
    rare_total, rare_words = np.zeros(TAIL), np.zeros(TAIL)
    kind = F.col("h").bitwiseAND(TAIL - 1)
    for r in counts.where(level < least).groupBy(kind.alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("m")).collect():
        rare_total[r["k"]], rare_words[r["k"]] = r["n"], r["m"]
    own = (h & np.uint64(TAIL - 1)).astype(np.int64)
    in_tail = np.arange(len(h)) >= head + body
    total = rare_total + np.bincount(own[in_tail], weights=n[in_tail], minlength=TAIL)
    total = np.maximum(total, 1)  # a class without words keeps the mass of one that the corpus hasn't
    rare = np.log(np.where(rare_words > 0, rare_total / np.maximum(rare_words, 1), 1) / total)
    number = np.where(in_tail, head + body + own, np.arange(len(h)))
    share = np.where(in_tail, np.log(n / total[own]), 0.0)
    of = np.arange(body) // width
    sums = np.bincount(of, weights=n[head : head + body]) if body else np.zeros(0)
    slots = np.concatenate([n[:head], sums, total])
    o = np.argsort(h)
    return Vocabulary(h[o], number[o].astype(np.int32), share[o].astype(np.float32), rare.astype(np.float32), slots / slots.sum(), n[head : head + body] / sums[of] if body else sums, head, width)


def fit(docs: DataFrame, rate: float = RATE, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, **options) -> Model:
    """Train on every document. options: of vocabulary()."""
    spark = docs.sparkSession
    v = vocabulary(docs, text, **options)
    rows = docs.select(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("k"), F.col(f"`{text}`").alias("t")).where("t is not null")
    shards = _exchange.block_count(rows.agg(F.sum(F.octet_length("t"))).first()[0], block_bytes)
    rows = rows.withColumn("block", F.pmod("k", F.lit(shards)).cast("int"))
    m = Model.first(v)
    if shards > 1:  # all blocks go on from what the first has learnt
        m = _averaged(m, _train(_exchange.pack_blocks(rows.where("block = 0"), 1), m, rate), 1)
    return _averaged(m, _train(_exchange.pack_blocks(rows, shards), m, rate), shards)


def _train(blocked: _exchange.Blocked, m: Model, rate: float) -> DataFrame:
    shared = blocked.df.sparkSession.sparkContext.broadcast(m)
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("n", pa.binary()), ("at", pa.binary()), ("x", pa.binary())])

    def train(table: pa.Table) -> pa.Table:
        block = int(table["block"][0].as_py())
        t = Trainer(shared.value.copy(), rate, block).run(_exchange.block_docs(table)[1])
        rows = [(part, block, np.full(len(i), float(t.seen)).tobytes(), i.tobytes(), x.astype(np.float32).tobytes()) for part, i, x in t.trained()] if t.seen else []
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    return blocked.df.groupBy("block").applyInArrow(train, _TRAINED)


def _averaged(m: Model, trained: DataFrame, shards: int) -> Model:
    """m with the mean of what the shards trained, weighted by words; rows that a shard left alone count as they are in m."""

    def average(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the rows of a range and shard group come one after the other
        now, got = None, {}

        def mean() -> pd.DataFrame:
            i = np.unique(np.concatenate([g[1] for g in got]))
            weight, total = np.zeros(len(i)), np.zeros((len(i), got[0][2].shape[1]))
            for n, at, x in got:
                k = np.searchsorted(i, at)
                weight[k] += n
                total[k] += n[:, None] * x
            return pd.DataFrame([(*now, weight.tobytes(), i.tobytes(), (total / weight[:, None]).astype(np.float32).tobytes())], columns=["part", "shard", "n", "at", "x"])

        got = []
        for pdf in batches:
            for part, shard, n, at, x in zip(*(pdf[c].tolist() for c in ("part", "shard", "n", "at", "x"))):
                if (part, shard // FAN) != now:
                    if got:
                        yield mean()
                    now, got = (part, shard // FAN), []
                at = np.frombuffer(at, np.int64)
                got.append((np.frombuffer(n, float), at, np.frombuffer(x, np.float32).reshape(len(at), -1)))
        if got:
            yield mean()

    while True:
        trained = trained.repartition("part", F.floor(F.col("shard") / FAN)).sortWithinPartitions("part", "shard").mapInPandas(average, _TRAINED)
        shards = -(-shards // FAN)
        if shards == 1:
            break
    means = trained.toArrow()
    m = m.copy()
    v = m.v
    parts = means["part"].to_pylist()
    if not parts:
        return m
    words = np.frombuffer(means["n"][parts.index(-1)].as_py(), float)[0]
    for part, n, at, x in zip(parts, means["n"], means["at"], means["x"]):
        i = np.frombuffer(at.as_py(), np.int64)
        x = np.frombuffer(x.as_py(), np.float32).reshape(len(i), -1)
        share = (np.frombuffer(n.as_py(), float) / words)[:, None]
        old = m.c if part == -1 else m.q if part == -2 else m.q2 if part % 2 else m.r
        old[i] += share.astype(np.float32) * (x - old[i])
    assert len(m.r) == v.start + 1
    return m


def lm_score(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity) of every row of docs.

    log_prob sums the natural log-probabilities of the words, each given the
    two before it, over the vocabulary of all words of docs. perplexity is
    exp(-log_prob / n_words), null without words; then log_prob is 0. A null
    text has nulls. Both are rounded to four places. Keys are passed through,
    null or repeated; equal texts get equal scores. Only the two named columns
    are read.
    """
    m = fit(docs, key=key, text=text, **options)
    shared = docs.sparkSession.sparkContext.broadcast(m)

    @F.pandas_udf("n_words bigint, log_prob double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for t in batches:
            n, s = np.zeros(len(t), np.int64), np.zeros(len(t))
            got: list[tuple[np.ndarray, ...]] = []

            def score() -> None:
                doc, w1, w2, w, share = (np.concatenate(x) for x in zip(*got))
                got.clear()
                p = m.log_prob(w1, w2, w, share)
                n[:] += np.bincount(doc, minlength=len(t))
                s[:] += np.bincount(doc, weights=p, minlength=len(t))

            for some in contexts(m.v, t.tolist()):
                got.append(some)
                if sum(len(g[0]) for g in got) >= SCORED:
                    score()
            if got:
                score()
            yield pd.DataFrame({"n_words": n, "log_prob": s})

    some = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").isNotNull().alias("ok"), run(F.col(f"`{text}`")).alias("x"))
    n, s = F.when(F.col("ok"), F.col("x.n_words")), F.when(F.col("ok"), F.col("x.log_prob"))
    return some.select("doc_id", n.alias("n_words"), F.round(s, 4).alias("log_prob"), F.when(n > 0, F.round(F.exp(-s / n), 4)).alias("perplexity"))
