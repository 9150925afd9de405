"""N-gram Jaccard join with prefix trees (operator 6).

Every text is the set of its word n-grams. The sets are ordered globally,
n-grams of few texts first, and two sets of similarity t share one
within their prefixes of |x| - ceil(t |x|) + 1. Texts meet where the n-grams
of their prefixes name a place; a group of near copies has few of them. There
its sets stand in a prefix tree, most frequent n-gram first. One walk takes all
probes along: the overlap of a path is kept for all sets below, a probe leaves
a subtree when what remains of it can't reach the overlap needed, and is linked
to all of a subtree at once when it has reached it. So links are counted, and
their connected classes found, without listing pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _exchange, _text
from ._common import cut, shuffle_partitions

NGRAM, THRESHOLD = 3, 0.5
#: A place with more bytes of sets is cut into parts, and every two parts meet in a task.
PART_BYTES = 1 << 20
TASK_BYTES = 2 << 20
#: Large places up to so many are broadcast, two numbers each.
BROADCAST = 100_000
_SIG = (1 << 40) - 1
_CANDIDATE = "place bigint, tid bigint, size int, places binary, grams binary"
_LINKED = "tid bigint, links bigint, root bigint"


def _sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram fingerprints of the texts: (fingerprints, text), sorted by both."""
    fps, own = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for w in _text.words(texts):
        h, ptr = _text.ngrams(w, n, short=True)
        fps.append(h >> np.uint64(64 - _exchange.BITS))
        own.append(np.repeat(np.arange(len(ptr) - 1) + w.first, np.diff(ptr)))
    f, d = np.concatenate(fps), np.concatenate(own)
    o = np.argsort(f, kind="stable")  # texts ascend already
    f, d = f[o], d[o]
    new = np.ones(len(f), dtype=bool)
    new[1:] = (f[1:] != f[:-1]) | (d[1:] != d[:-1])
    return f[new], d[new]


def _need(t: float, a: int | np.ndarray, b: int | np.ndarray) -> np.ndarray:
    """The least overlap of sets of sizes a and b with similarity t."""
    return np.ceil(t / (1 + t) * (np.asarray(a) + b) - 1e-9).astype(np.int64)


def _own(docs: _exchange.Docs) -> tuple[np.ndarray, list[str]]:
    """Keys of the texts of a block and the texts, each once. docs are sorted by key and text."""
    keys, texts = docs
    new = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.zeros(0, bool)
    return keys[new], [texts[i] for i in np.flatnonzero(new).tolist()]


def candidates(docs: DataFrame, n: int, t: float, text: str) -> DataFrame:
    """A row for every text and meeting place of its prefix: its n-grams that other candidates have too.

    A text of x n-grams needs t x that others have. The first round of
    questions finds the texts for which that holds, the second who of these has
    which n-gram. Of an n-gram's texts the one of the smallest hash names its
    meeting place, so those of a group of near copies mostly meet at one. The
    global order puts n-grams without a second text first, then those whose
    texts have several n-grams in common, by the logarithm of their number of
    texts and by place; it is the same in every text. places: all of its places.
    """

    def all_sets(docs: _exchange.Docs, answers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        f, d = _sets(_own(docs)[1], n)
        # a block asks once for what several of its texts have
        each = np.unique(f)
        return each, np.zeros(len(each), np.uint16)

    def repeats(f: np.ndarray, payload: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]])) if len(f) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(f)))
        return np.repeat((size > 1).astype(np.uint32), size), np.arange(2, dtype=np.uint64)[:, None]

    def live_sets(texts: list[str], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Repeated n-grams of the texts that have enough of them: fingerprints, texts; and all sizes."""
        f, d = _sets(texts, n)
        size = np.bincount(d, minlength=len(texts))
        if not bits.size:
            return f[:0], d[:0], size
        each, back, many = np.unique(f, return_inverse=True, return_counts=True)
        common = ((bits[0] > 0) | (many > 1))[back]
        return *_enough(f, d, common, size), size

    def _enough(f: np.ndarray, d: np.ndarray, common: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        live = np.bincount(d[common], minlength=len(size)) >= np.maximum(1, np.ceil(t * size - 1e-9))
        keep = common & live[d]
        return f[keep], d[keep]

    def live(docs: _exchange.Docs, answers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        f, d, _ = live_sets(_own(docs)[1], answers[0])
        return f, d.astype(np.uint32)

    def lists(f: np.ndarray, doc: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(f):
            return np.zeros(0, np.uint32), np.zeros((1, 2), np.uint64)
        start = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
        df = np.diff(np.append(start, len(f)))
        who = _text.mix((block.astype(np.uint64) << np.uint64(32)) | doc)
        many = df > 1
        sig = (np.minimum(df, (1 << 24) - 1).astype(np.uint64) << np.uint64(40)) | (np.bitwise_xor.reduceat(who, start) & np.uint64(_SIG))
        # equal lists of texts have equal numbers
        both, number = np.unique(np.stack([sig[many], np.minimum.reduceat(who, start)[many]], axis=1), axis=0, return_inverse=True)
        each = np.zeros(len(df), np.uint32)
        each[many] = number.ravel() + 1
        return np.repeat(each, df), np.concatenate([np.zeros((1, 2), np.uint64), both])

    arrow = pa.schema([("place", pa.int64()), ("tid", pa.int64()), ("size", pa.int32()), ("places", pa.binary()), ("grams", pa.binary())])

    def result(block: int, docs: _exchange.Docs, answers: list[np.ndarray]) -> pa.Table:
        keys, texts = _own(docs)
        bits, words = answers
        f, d, size = live_sets(texts, bits)
        out: list[tuple] = []
        if words.size:
            sig, place = words
            keep = sig > 0
            f, d, sig, place = f[keep], d[keep], sig[keep], place[keep]
            o = np.argsort(d, kind="stable")
            f, d, sig, place = f[o], d[o], sig[o], place[o]
            for doc, lo, hi in zip(*_runs(d)):
                least = int(np.ceil(t * size[doc] - 1e-9))
                prefix = hi - lo - least + 1
                if prefix < 1:
                    continue
                kinds, first, many = np.unique(sig[lo:hi], return_index=True, return_counts=True)
                at = place[lo:hi][first]
                df = np.log2((kinds >> np.uint64(40)).astype(float)).astype(int)
                order = np.lexsort((kinds, at, df, many < 4))
                used = order[: int(np.searchsorted(np.cumsum(many[order]), prefix)) + 1]
                places = (np.unique(at[used]) >> np.uint64(1)).astype(np.int64)
                blob, listed = _exchange.pack_sorted(f[lo:hi]), places.tobytes()
                out.extend((p, int(keys[doc]), int(size[doc]), listed, blob) for p in places.tolist())
        return pa.Table.from_arrays([pa.array(c, type=s.type) for c, s in zip(zip(*out) if out else [[]] * 5, arrow)], schema=arrow)

    blocked = _exchange.text_blocks(docs, F.col(f"`{text}`"))
    answers = _exchange.ask(blocked, live, lists, _exchange.ask(blocked, all_sets, repeats), np.uint32)
    return _exchange.finish(blocked, answers, 2, result, _CANDIDATE)


def _runs(d: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    start = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.zeros(0, np.int64)
    return d[start].tolist(), start.tolist(), np.append(start[1:], len(d)).tolist()


class Trie:
    """Sets as paths from the most frequent element on, in depth first order."""

    #: Bytes of the table of probes and elements.
    TABLE = 32 << 20

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.elements, code, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.rank = np.empty(len(self.elements), dtype=np.int64)
        self.rank[np.argsort(-many, kind="stable")] = np.arange(len(self.elements))
        paths = [np.sort(p) for p in np.split(self.rank[code], np.cumsum([len(s) for s in sets])[:-1])]
        self.order = np.array(sorted(range(len(sets)), key=lambda i: paths[i].astype(">i4").tobytes()))
        self.paths = [paths[i] for i in self.order.tolist()]
        self.sizes = sizes[self.order]
        self.length = np.array([len(p) for p in self.paths])
        # depth at which a path leaves the one before it
        self.shared = np.array([0, *(_agree(a, b) for a, b in zip(self.paths, self.paths[1:]))])

    def probe(self, sets: list[np.ndarray], sizes: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, int, int]]:
        """(probes, lo, hi): every one of the probes is similar to each of order[lo:hi], each such two once."""
        step = max(1, self.TABLE // max(1, len(self.elements)))
        for lo in range(0, len(sets), step):
            for who, a, b in self._walk(sets[lo : lo + step], sizes[lo : lo + step], t):
                yield who + lo, a, b

    def _walk(self, sets: list[np.ndarray], sizes: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, int, int]]:
        own = np.zeros(len(sets), dtype=np.int64)
        has = np.zeros((len(self.elements), len(sets)), dtype=np.uint8)
        for k, s in enumerate(sets):
            i = np.minimum(np.searchsorted(self.elements, s), len(self.elements) - 1)
            i = self.rank[i[self.elements[i] == s]]
            own[k] = len(i)
            has[i, k] = 1
        # leaves, depth and, of the probes that are there, number and overlap
        todo = [(0, len(self.paths), 0, np.arange(len(sets)), np.zeros(len(sets), np.int64))]
        while todo:
            a, b, depth, who, overlap = todo.pop()
            end = int(self.shared[a + 1 : b].min()) if b - a > 1 else int(self.length[a])
            if end > depth:
                edge = self.paths[a][depth:end]
                every = len(who) * 2 > len(sets)
                new = np.zeros(len(sets) if every else len(who), np.int64)
                for lo in range(0, len(edge), 255):  # sums of bytes up to 255
                    some = has[edge[lo : lo + 255]] if every else has[edge[lo : lo + 255, None], who]
                    new += some.sum(axis=0, dtype=np.uint8)
                overlap = overlap + (new[who] if every else new)
            size = self.sizes[a:b]
            low, high, remain = int(size.min()), int(size.max()), int(self.length[a:b].max()) - end
            can = overlap + np.minimum(own[who] - overlap, remain) >= _need(t, low, sizes[who])
            sure = can & (overlap >= _need(t, high, sizes[who]))
            if sure.any():
                yield who[sure], a, b
            rest = can & ~sure
            if not rest.any() or b - a == 1:
                continue
            who, overlap = who[rest], overlap[rest]
            cuts = [a, *(np.flatnonzero(self.shared[a + 1 : b] == end) + a + 1).tolist(), b]
            todo.extend((x, y, end, who, overlap) for x, y in zip(cuts, cuts[1:]))


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    return int(differ[0]) if len(differ) else m


def links(sets: list[np.ndarray], sizes: np.ndarray, t: float, kinds: list[bytes], place: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each set the number of similar ones, and the smallest number of one it is connected to.

    sets: sorted fingerprints that sets may share; sizes: of the whole sets.
    kinds: the places of each; two sets count only where the first place they
    have in common is this one. side: count only those of different sides.
    """
    count, group = np.zeros(len(sets), np.int64), np.arange(len(sets))
    by: dict[tuple[bytes, int], list[int]] = {}
    for i, k in enumerate(kinds):
        by.setdefault((k, 0 if side is None else int(side[i])), []).append(i)
    keys = sorted(by)
    at = {k: set(np.frombuffer(k, np.int64).tolist()) for k, _ in keys}

    def connect(i: np.ndarray) -> None:
        g = np.unique(group[i])
        if len(g) > 1:
            group[np.isin(group, g)] = g[0]

    for x, k in enumerate(keys):
        others = [o for o in (keys[x:] if side is None else keys) if (side is None or k[1] < o[1]) and min(at[k[0]] & at[o[0]]) == place]
        if not others:
            continue
        mine = np.array(by[k])
        them = np.concatenate([by[o] for o in others])
        alone = others == [k]
        if alone and len(mine) == 1:
            continue
        if len(mine) == 1 or alone and len(mine) == 2:
            # a path of its own: the overlaps are those of two sets
            for j in them.tolist() if len(mine) == 1 else [int(mine[1])]:
                i = int(mine[0])
                if i != j and len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= _need(t, sizes[i], sizes[j]):
                    count[[i, j]] += 1
                    connect(np.array([i, j]))
            continue
        trie = Trie([sets[i] for i in mine.tolist()], sizes[mine])
        leaves = np.zeros(len(mine) + 1, np.int64)
        inside = np.isin(them, mine)  # these meet each other twice, and themselves
        for who, a, b in trie.probe([sets[j] for j in them.tolist()], sizes[them], t):
            count[them[who]] += b - a
            other = int((~inside[who]).sum())
            leaves[a] += other
            leaves[b] -= other
            connect(np.concatenate([them[who], mine[trie.order[a:b]]]))
        count[mine[trie.order]] += np.cumsum(leaves)[:-1]
        if inside.any():
            # a set meets itself, and is found if enough of it is shared
            count[mine] -= np.array([len(sets[i]) for i in mine.tolist()]) >= _need(t, sizes[mine], sizes[mine])
    return count, group


def linked(docs: DataFrame, n: int, t: float, text: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(tid, links, root) of the texts with similar ones: partial counts, and edges that connect what links connect."""
    spark = docs.sparkSession
    rows = cut(candidates(docs, n, t, text))
    weight = F.sum(F.octet_length("grams") + 500).cast("bigint").alias("b")
    large = cut(rows.groupBy("place").agg(weight).where(F.col("b") > part_bytes).select("place", F.ceil(F.col("b") / part_bytes).cast("int").alias("c"), "b"))
    few, more = large.agg(F.count("*"), F.sum(F.col("c") * F.col("b"))).first()
    parts = max(shuffle_partitions(spark), ((rows.agg(weight).first()[0] or 0) + (more or 0)) // TASK_BYTES)
    large = large.drop("b")
    rows = rows.join(F.broadcast(large) if few <= BROADCAST else large, "place", "left")
    part = F.pmod(F.xxhash64("tid"), F.coalesce("c", F.lit(1))).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("c", F.lit(1)) - 1), lambda x: F.struct(F.least(x, "p").alias("i"), F.greatest(x, "p").alias("j")))
    rows = rows.withColumn("p", part).select("place", F.explode(pairs).alias("w"), "tid", "size", "places", "grams", "p").select("place", "w.i", "w.j", "tid", "size", "places", "grams", "p")
    arrow = pa.schema([("tid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []
        held = 0
        for (place, i, j), group in groupby((row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in range(8)))), key=itemgetter(0, 1, 2)):
            tid, size, places, grams, side = zip(*(row[3:] for row in group))
            if len(tid) == 1:
                continue
            tid = np.array(tid)
            count, root = links([_exchange.unpack_sorted(g) for g in grams], np.array(size, np.int64), t, list(places), place, None if i == j else np.array(side) == j)
            some = count > 0
            out.append((tid[some], count[some], tid[root[some]]))
            held += len(out[-1][0])
            if held >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], schema=arrow)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], schema=arrow)

    return rows.repartition(parts, "place", "i", "j").sortWithinPartitions("place", "i", "j", "tid").mapInArrow(join, _LINKED)


def jaccard_join(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, class_id, links) of every row of docs.

    Two texts are linked if the sets of their word n-grams, whatever the case
    and punctuation, have a similarity common / (size_a + size_b - common) of at
    least threshold; a text of 1 to n - 1 words has one n-gram, all of it. links
    counts the other texts that a text is linked to: all of them, copies of a
    text as one. class_id is the smallest key of the rows whose texts are equal
    or connected by links, directly or through others. Texts without words are
    linked to none, a null text isn't equal to another either: its class is its
    own key. Rows that repeat a key or text each have their row; a null key is
    in a class and gives it no name. Only the two named columns are read.
    """
    got = cut(linked(docs, n, threshold, text, part_bytes))
    count = got.groupBy("tid").agg(F.sum("links").alias("links"))
    groups = components(got, "tid", "root").select(F.col("doc_id").alias("tid"), F.col("group_id").alias("g"))
    rows = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), _exchange.text_key(F.col(f"`{text}`")).alias("tid"), F.col(f"`{text}`").isNull().alias("none"))
    # copies are combined in each task before they meet
    texts = rows.where("not none").groupBy("tid").agg(F.min("doc_id").alias("least"))
    texts = texts.join(groups, "tid", "left").join(count, "tid", "left").select("tid", "least", F.coalesce("g", "tid").alias("g"), F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))
    classes = texts.groupBy("g").agg(F.min("least").alias("class_id"))
    named = texts.join(classes, "g").select("tid", "class_id", "links")
    with_text = rows.where("not none").join(named, "tid").select("doc_id", "class_id", "links")
    return with_text.unionAll(rows.where("none").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("links")))


def components(pairs: DataFrame, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """(doc_id, group_id) of every document in a pair: the smallest id it is connected to.

    Large and small stars alternate until nothing changes, a logarithmic number
    of rounds; each round's edges are cut off in the shared folder. The least
    neighbour of a hub is found by partial minima and joined to its edges, which
    a skewed join may split.
    """
    edges = cut(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = cut(small.select("u", "m").unionAll(small.select("v", "m")).toDF("u", "v").where("u <> v").distinct())
        new = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("group_id")).unionAll(edges.select("v", "v").distinct())


SQL = rf"""
WITH RECURSIVE t AS (SELECT text, min(doc_id) AS least, regexp_extract_all(lower(text), '{_text.WORD_SQL}') AS w FROM documents WHERE text IS NOT NULL GROUP BY text),
n AS (SELECT row_number() OVER (ORDER BY text) AS id, least, text, list_distinct(CASE WHEN len(w) < {NGRAM} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {NGRAM} + 2), lambda i: array_to_string(w[i:i + {NGRAM} - 1], ' ')) END) AS s, len(w) AS words FROM t),
e AS (SELECT id, len(s) AS size, unnest(s) AS gram FROM n WHERE words > 0),
p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.gram = b.gram AND a.id <> b.id GROUP BY a.id, b.id
  HAVING count(*) >= {THRESHOLD} * (any_value(a.size) + any_value(b.size) - count(*))),
r AS (SELECT id, id AS other FROM n UNION SELECT r.id, p.b FROM r JOIN p ON r.other = p.a),
c AS (SELECT r.id, min(n.least) AS class_id FROM r JOIN n ON n.id = r.other GROUP BY r.id),
l AS (SELECT a AS id, count(*) AS links FROM p GROUP BY a)
SELECT d.doc_id, c.class_id, coalesce(l.links, 0) AS links FROM documents d JOIN n USING (text) JOIN c USING (id) LEFT JOIN l USING (id)
UNION ALL SELECT doc_id, doc_id, 0 FROM documents WHERE text IS NULL
"""
