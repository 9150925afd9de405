import random

import numpy as np
from pyspark.sql import functions as F

from trustloom.llm import lm_score, quality, toxicity
from trustloom.llm._labelled import labelled
from trustloom.llm._text import word_hash


def data(spark, n=700, seed=0):
    r = random.Random(seed)
    words = [f"word{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(n):
        x = [r.choice(words) for _ in range(r.randrange(8, 60))]
        bad, poor = r.random() < 0.25, r.random() < 0.3
        if bad:
            for _ in range(3):
                x.insert(r.randrange(len(x)), r.choice(["grumpf" + r.choice("abcdefgh"), "idiot"]))
        if poor:
            x = [w + "###" if r.random() < 0.5 else "junk" + w for w in x]
        rows.append((i, " ".join(x), 1, "y"))
        if i < 0.7 * n:
            labels.append((i, int(not poor), int(bad)))
        else:
            labels.append((-i - 1, int(not poor), int(bad)))  # kept apart for the test
    rows += [(9000, None, 1, "y"), (9001, "", 1, "y"), (None, "idiot", 1, "y"), (9002, "word1 " * 50_000, 1, "y"), (5, rows[5][1], 1, "y")]
    labels += [(None, 1, 1), (9000, 1, 0), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, margin int, t string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held_out(got, labels, name):
    truth = {-r["doc_id"] - 1: r[name] for r in labels.collect() if r["doc_id"] is not None and r["doc_id"] < 0}
    pred = {r["doc_id"]: r[name] for r in got.collect()}
    return sum(pred[k] == v for k, v in truth.items()) / len(truth)


def test_toxicity(spark):
    docs, labels = data(spark)
    got = toxicity.toxicity(docs, labels).cache()
    assert held_out(got, labels, "toxic") > 0.95
    special = {r["doc_id"]: r for r in got.where("doc_id >= 9000 or doc_id is null").collect()}
    assert special[9000]["toxicity"] is None and special[9000]["toxic"] == 0 and special[9001]["toxic"] == 0 and special[9002]["toxic"] == 0
    assert got.count() == docs.count() and got.where("doc_id = 5").distinct().count() == 1
    assert toxicity.toxicity(docs, labels.where("toxic = 0")).agg(F.sum("toxic")).first()[0] == 0
    assert toxicity.toxicity(docs.where("false"), labels).collect() == []


def test_isotonic_rises():
    s = np.array([1.0, 2, 3, 4, 5, 5])
    k = toxicity.isotonic(s, np.array([0, 1, 0, 1, 1, 0.0]))
    assert (np.diff(k[1]) >= 0).all() and (np.diff(k[0]) >= 0).all()


def test_quality(spark):
    docs, labels = data(spark)
    got = quality.quality(docs, labels).cache()
    assert held_out(got, labels, "quality") > 0.95
    special = {r["doc_id"]: r for r in got.where("doc_id >= 9000").collect()}
    assert special[9000]["margin"] is None and special[9000]["quality"] == 0
    assert got.count() == docs.count()
    assert {r["quality"] for r in quality.quality(docs, labels.where("quality = 1")).where("doc_id <> 9000").collect()} == {1}
    assert quality.quality(docs.where("false"), labels).collect() == []


def test_dual_coordinate_descent_separates():
    rows = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])]
    y = np.array([1.0, 1, -1, -1])
    w, b = quality.dual_coordinate_descent(rows, y, np.ones(4), np.full(4, 10.0), 200)
    assert all(np.sign(w[r].sum() + b) == s for r, s in zip(rows, y))
    assert np.allclose([y[i] * (w[r].sum() + b) for i, r in enumerate(rows)], 1, atol=0.05)


def test_labels_of_absent_documents_change_nothing(spark):
    docs, labels = data(spark, 60)
    foreign = spark.range(10_000, 14_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    both = labels.unionByName(foreign)
    own = sorted(map(str, labelled(docs, labels, "quality", 20).collect()))
    assert len(own) == 20 and own == sorted(map(str, labelled(docs.repartition(5), both, "quality", 20).collect()))
    hot = docs.unionAll(spark.range(3000).selectExpr("7 as doc_id", "concat('t', id) as text", "1", "'y'"))
    assert labelled(hot, labels, "quality", 20).count() == 20  # a key of many rows is one


def test_features_one_text_at_a_time():
    r = random.Random(3)
    texts = ["", None, "You IDIOT!! i-d-i0t aa\n\n", "x", "é", "\n", *("".join(r.choice("aAbB .!?*#$1 \n") for _ in range(r.randrange(90))) for _ in range(80))]
    m = toxicity.Model()
    got = toxicity.features(texts, m)
    for t, x in zip(texts, got):
        assert np.array_equal(x, toxicity.features([t], m)[0])
        b = (t or "").encode()
        if b:
            alpha = [chr(c).isalpha() and c < 128 for c in b]
            inner = sum(alpha[i - 1] and alpha[i + 1] and chr(b[i]) in "0123456789*#$%&@^~|" for i in range(1, len(b) - 1))
            twice = sum(b[i] == b[i - 1] and b[i] != 32 for i in range(1, len(b)))
            upper = sum(65 <= c < 91 for c in b)
            want = [inner / len(b), twice / len(b), upper / max(1, sum(alpha)), sum(c in b"!?" for c in b) / len(b), sum(c in b"*#$%&@^~|" for c in b) / len(b)]
            assert np.allclose(x[13:], want)
        else:
            assert not x.any()


def test_trees_against_brute_force():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (80, 3)).astype(np.float32)
    y = ((x[:, 0] > 2) ^ (x[:, 2] > 3)).astype(float)
    base, (tree,) = toxicity._boost(x, y, 1, 1, 0.5)
    p = y.mean()
    assert abs(base - np.log(p / (1 - p))) < 1e-9
    g, h = p - y, np.full(80, p * (1 - p))
    part = lambda i: g[i].sum() ** 2 / (h[i].sum() + 1)
    gain = {(j, v): part(x[:, j] <= v) + part(x[:, j] > v) - part(x[:, j] < 99) for j in range(3) for v in range(5)}
    feature, threshold, value = tree
    assert gain[int(feature[1]), int(threshold[1])] >= max(gain.values()) - 1e-9
    left = x[:, feature[1]] <= threshold[1]
    assert np.allclose(value[2:4], [-0.5 * g[i].sum() / (h[i].sum() + 1) for i in (left, ~left)])


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(30):
        y = rng.integers(0, 2, 9).astype(float)
        k = toxicity.isotonic(np.arange(9.0), y)
        fit = np.interp(np.arange(9.0), k[0], k[1])
        # least squares under monotony: max over starts of min over ends of the means
        want = [max(min(y[a : b + 1].mean() for b in range(i, 9)) for a in range(i + 1)) for i in range(9)]
        assert np.allclose(fit, want)


def test_dual_objective_and_class_ratios(spark):
    rng = np.random.default_rng(6)
    rows = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(12)]
    y, ratio, cost = np.where(rng.random(12) < 0.5, 1.0, -1.0), rng.normal(size=6), np.full(12, 0.7)
    w, b = quality.dual_coordinate_descent(rows, y, ratio, cost, 5000)
    x = np.zeros((12, 7))
    for i, r in enumerate(rows):
        x[i, r], x[i, 6] = ratio[r], 1
    primal = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    v = np.append(w, b)
    assert all(primal(v) <= primal(v + rng.normal(size=7) * s) + 1e-2 for s in (0.5, 0.1, 0.02) for _ in range(200))
    docs = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, "a b"), (4, "c c"), (5, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 0), (5, 0)], "doc_id long, quality int")
    m = quality.fit(docs, labels, least=1, mixed=0.0, c=1.0)
    full = quality.fit(docs, labels, least=1, mixed=1.0, c=1.0)
    n = {"a": (3, 0), "b": (2, 0), "c": (1, 2), "d": (0, 1), "a b": (2, 0), "a c": (1, 0), "c c": (0, 1), "c d": (0, 1)}
    good, bad = (sum(x[i] + 1 for x in n.values()) for i in (0, 1))
    at = {int(h): float(v) for h, v in zip(m.grams, m.weights)}
    gram = lambda g: int(next(quality.indicators([g]))[1][0])
    scale = {g: at[gram(g)] / np.log((n[g][0] + 1) / good / ((n[g][1] + 1) / bad)) for g in "abcd"}
    assert max(scale.values()) - min(scale.values()) < 1e-9 and len(full.grams) <= 8


def bigram_rows(spark, n):
    r = random.Random(1)
    follow = {f"a{i}": [f"a{(i * 7 + j) % 40}" for j in (1, 2)] for i in range(40)}
    rows = []
    for i in range(n):
        w = ["a0"]
        for _ in range(120):
            w.append(r.choice(follow[w[-1]]))
        rows.append((i, " ".join(w)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def whole(m, words, w1, w2):
    """Sum of the probabilities of all words of the corpus after a context."""
    w, share = m.v.find(np.array([word_hash(x) for x in words], np.uint64))
    return np.exp(m.log_prob(np.full(len(w), w1), np.full(len(w), w2), w, share)).sum()


def plain(m, w1, w2, w, share):
    """A probability by the definition."""
    step = lambda x: np.rint(x * 256) / 256
    v, h = m.v, step(np.append((m.c[0] * m.r[w1] + m.c[1] * m.r[w2])[:-1], 1).astype(float))
    s = np.exp(step(m.q.astype(float)) @ h)
    p = s[int(v.slot(np.array([w]))[0])] / s.sum()
    if v.head <= w < v.head + v.body:
        lo = (w - v.head) // v.width * v.width
        s = np.exp(step(m.q2[lo : lo + v.width].astype(float)) @ h)
        p *= s[w - v.head - lo] / s.sum()
    return np.log(p) + share


def test_lm_learns_and_is_normalised(spark):
    docs = bigram_rows(spark, 2500)
    s = lm_score.lm_score(docs, block_bytes=400_000).agg(F.sum("log_prob"), F.sum("n_words")).first()
    assert -s[0] / s[1] < 2.2  # two of forty words follow each: 0.7 at best, 3.7 for the unigram
    for shape in ({}, {"head": 4, "classes": 3, "width": 5, "known": 30}, {"head": 0, "classes": 4, "width": 20, "known": 40}, {"head": 3, "classes": 0, "width": 1, "known": 3}):
        m = lm_score.fit(docs.limit(200), **shape)
        words = [f"a{i}" for i in range(40)]
        live = m.v.noise[-m.v.tail :].sum() if shape and shape["head"] + shape["classes"] * shape["width"] < 40 else 0
        for a, b in ((m.v.start, m.v.start), (0, 1), (2, m.v.start)):
            total = whole(m, words, a, b)
            assert total < 1 + 1e-4 and (live or total > 0.9)
            w, share = m.v.find(np.array([word_hash(x) for x in words], np.uint64))
            got = m.log_prob(np.full(40, a), np.full(40, b), w, share)
            assert np.allclose(got, [plain(m, a, b, x, y) for x, y in zip(w.tolist(), share.tolist())], atol=1e-4)


def test_lm_tail_has_the_shares_of_the_counts(spark):
    words = [f"t{i}" for i in range(2000)]
    docs = spark.createDataFrame([(i, " ".join([w] * (i % 5 + 1))) for i, w in enumerate(words)], "doc_id long, text string")
    v = lm_score.vocabulary(docs, head=10, classes=4, width=10, known=900)
    w, share = v.find(np.array([word_hash(x) for x in words], np.uint64))
    assert (np.sort(w[w < 50]) == np.arange(50)).all() and np.isclose(v.noise.sum(), 1)
    for k in range(v.tail):  # shares of a class sum to 1, the rarer ones are equal
        of = w == 50 + k
        assert abs(np.exp(share[of]).sum() - 1) < 1e-4
    counts = np.array([i % 5 + 1 for i in range(2000)])
    total = np.bincount(w[w >= 50] - 50, weights=counts[w >= 50], minlength=v.tail)
    exact = (counts >= 4) & (w >= 50)
    assert np.allclose(share[exact], np.log(counts[exact] / total[w[exact] - 50]), atol=1e-5)
    assert np.isclose(v.noise[-v.tail :] * counts.sum(), total).all()
    m = lm_score.Model.first(v)
    assert abs(whole(m, words, 5, v.start) - 1) < 1e-3


def test_lm_one_step_against_differences():
    rng = np.random.default_rng(8)
    n = np.array([9, 7, 5, 4, 3, 2, 1.0])
    v = lm_score.Vocabulary(np.arange(7, dtype=np.uint64), np.arange(7, dtype=np.int32), np.zeros(7, np.float32), np.zeros(1, np.float32), np.array([9, 7, 9, 5, 1, 1]) / 32, n[2:] / np.array([9, 9, 5, 5, 1]), 2, 2)
    m = lm_score.Model.first(v)
    for k, x in enumerate(m.parts()):
        setattr(m, "r q q2 c".split()[k], x.astype(np.float64) + rng.normal(size=x.shape) * 0.3)
    w1, w2, w, noise = (rng.integers(0, k, 6) for k in (7, 7, 7, 6))
    body = w[(w >= 2)] - 2
    at = np.minimum(body[:, None] // 2 * 2 + rng.integers(0, 2, (len(body), 2)), 4)
    t = lm_score.Trainer(m, 0.1, 0)

    def loss(m):
        h = m.c[0] * m.r[w1] + m.c[1] * m.r[w2]
        h[:, -1] = 1
        bits = lambda s: np.logaddexp(0, s).sum()
        out = bits(-(np.einsum("ij,ij->i", h, m.q[v.slot(w)]) - t.log_noise[v.slot(w)])) + bits(h @ m.q[noise].T - t.log_noise[noise])
        hb = h[w >= 2]
        return out + bits(-(np.einsum("ij,ij->i", hb, m.q2[body]) - t.log_inside[body])) + bits(np.einsum("ij,ikj->ik", hb, m.q2[at]) - t.log_inside[at])

    summed, lm_score._summed = lm_score._summed, lambda i, g: (np.unique(i), np.stack([g[i == k].sum(axis=0) for k in np.unique(i)]))
    got = t.gradients(w1, w2, w, noise, at)
    lm_score._summed = summed
    for k, i, g in got:
        x = m.parts()[k]
        rows = np.arange(len(x))[i]
        for row, want in zip(rows, g):
            for j in range(x.shape[1] - (k in (0, 3))):
                old = x[row, j]
                x[row, j] = old + 1e-5
                up = loss(m)
                x[row, j] = old - 1e-5
                down = loss(m)
                x[row, j] = old
                assert abs((up - down) / 2e-5 - want[j] * (len(w) if k == 3 else 1)) < 1e-4
    i, g = np.array([3, 1, 3, 70_000]), rng.normal(size=(4, 16)).astype(np.float32)
    rows, sums = summed(i, g)
    assert rows.tolist() == [1, 3, 70_000] and np.allclose(sums, [g[1], g[0] + g[2], g[3]])


def test_lm_scores_do_not_depend_on_partitions(spark):
    docs, _ = data(spark, 300)
    one, two = ({(r["doc_id"], r["log_prob"], r["perplexity"]) for r in lm_score.lm_score(docs.repartition(n), block_bytes=20_000).collect()} for n in (1, 7))
    assert sorted(one ^ two, key=str) == [] and len(one) > 300


def test_lm_edges(spark):
    docs = spark.createDataFrame([(1, "a b a b c", 1), (2, None, 1), (3, "", 1), (None, "a", 1), (4, "zz", 1), (1, "a b a b c", 1), (5, "long words " * 60_000, 1)], "doc_id long, text string, n int")
    got = lm_score.lm_score(docs, head=2, classes=1, width=1).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 7 and by[2]["n_words"] is None and by[3]["n_words"] == 0 and by[3]["perplexity"] is None and by[4]["n_words"] == 1 and by[5]["n_words"] == 120_000
    assert len({(r["log_prob"], r["perplexity"]) for r in got if r["doc_id"] == 1}) == 1 and np.isfinite(by[None]["log_prob"])
    assert lm_score.lm_score(docs.where("false")).collect() == []
    assert lm_score.lm_score(docs.where("doc_id = 3")).first()["log_prob"] == 0


def test_lm_unknown_text_is_not_preferred(spark):
    docs = bigram_rows(spark, 300).unionAll(spark.createDataFrame([(9000, " ".join(f"never{i}" for i in range(50)))], "doc_id long, text string"))
    got = {r["doc_id"]: r["perplexity"] for r in lm_score.lm_score(docs, head=8, classes=2, width=8, known=40).collect()}
    assert got[9000] > 5 * max(v for k, v in got.items() if k != 9000)
