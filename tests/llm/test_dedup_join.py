import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from trustloom.llm import _text
from trustloom.llm.exact_dedup import exact_dedup
from trustloom.llm.jaccard_join import Trie, components, jaccard_join, links

SCHEMA = "doc_id long, text string, key string, h int, grams string, copies int"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "k", 1, None, 5) for k, t in rows], SCHEMA)


def grams(t, n):
    for w in _text.words([t]):
        x = w.text(0, len(w.hashes))
        return {tuple(x)} if 0 < len(x) < n else {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}
    return set()


def brute(rows, n, t):
    """(key, class, links) of each row."""
    sets = {x: grams(x, n) for _, x in rows if x is not None}
    texts = list(sets)
    near = {x: {y for y in texts if y != x and (c := len(sets[x] & sets[y])) and c >= t * (len(sets[x]) + len(sets[y]) - c)} for x in texts}
    out = []
    for k, x in rows:
        if x is None:
            out.append((k, k, 0))
            continue
        seen, todo = {x}, [x]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out.append((k, min((j for j, y in rows if y in seen and j is not None), default=None), len(near[x])))
    return sorted(out, key=str)


def corpus(r):
    words = [f"w{i}" for i in range(60)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    rows, k = [], 0
    for _ in range(12):
        base = text(r.randrange(3, 90))
        for _ in range(r.randrange(1, 7)):
            x = list(base)
            for _ in range(r.randrange(0, 6)):
                i = r.randrange(len(x))
                x[i : i + 1] = r.choice([[], [r.choice(words)], text(2)])
            rows.append((k, " ".join(x)))
            k += 1
    shared = text(12)
    rows += [(k + i, " ".join(text(10) + shared + text(r.randrange(20)))) for i in range(8)]
    return rows + [(500, rows[0][1]), (501, rows[0][1].upper() + "!"), (502, None), (503, ""), (504, "w1"), (505, "w1"), (506, "w1 w2"), (None, rows[0][1]), (507, rows[3][1]), (507, rows[3][1]), (508, "w9 " * 50)]


def test_join_against_brute_force(spark):
    for seed, (n, t, part_bytes) in enumerate(((3, 0.5, 1 << 20), (1, 0.8, 1 << 20), (2, 0.3, 1500))):
        rows = corpus(random.Random(seed))
        got = jaccard_join(frame(spark, rows), n, t, part_bytes=part_bytes).collect()
        assert sorted((tuple(x) for x in got), key=str) == brute(rows, n, t)


@given(st.lists(st.sets(st.integers(0, 25), min_size=1), min_size=1, max_size=12), st.sampled_from([0.2, 0.5, 0.7, 1.0]), st.lists(st.integers(0, 5), min_size=12, max_size=12), st.lists(st.sets(st.integers(1, 3), min_size=1), min_size=12, max_size=12), st.integers(1, 5000))
@settings(max_examples=300, deadline=None)
def test_links(sets, t, extra, places, table):
    sizes = np.array([len(s) + e for s, e in zip(sets, extra)])
    kinds = [np.array(sorted(p), np.int64).tobytes() for p in places[: len(sets)]]
    arrays = [np.array(sorted(s), np.uint64) for s in sets]

    def similar(i, j):
        c = len(sets[i] & sets[j])
        return c and c >= t * (sizes[i] + sizes[j] - c) - 1e-9

    Trie.TABLE, before = table, Trie.TABLE
    m = range(len(sets))
    counts, pairs = np.zeros(len(sets), int), set()
    for place in (1, 2, 3):  # each two count at one of the places where they meet
        here = [i for i in m if place in places[i]]
        count, group = links([arrays[i] for i in here], sizes[here], t, [kinds[i] for i in here], place)
        counts[here] += count
        pairs |= {(here[g], i) for i, g in zip(here, group)}
    want = [(i, j) for i in m for j in range(i) if places[i] & places[j] and similar(i, j)]
    assert counts.tolist() == [sum(i in p for p in want) for i in m]
    assert closure(pairs, len(sets)) == closure(want, len(sets))
    side = np.array([e % 2 for e in extra[: len(sets)]], bool)
    count, group = links(arrays, sizes, t, [kinds[0]] * len(sets), min(places[0]), side)
    want = [(i, j) for i in m for j in range(i) if side[i] != side[j] and similar(i, j)]
    assert count.tolist() == [sum(i in p for p in want) for i in m]
    assert closure(enumerate(group.tolist()), len(sets)) == closure(want, len(sets))
    Trie.TABLE = before


def closure(pairs, n):
    group = list(range(n))
    for i, j in pairs:
        group = [group[i] if g == group[j] else g for g in group]
    return [group.index(g) for g in group]


def test_components(spark):
    pairs = spark.createDataFrame([(3, 9), (9, 12), (1, 12), (20, 21), (21, 22), (23, 22)], "doc_a long, doc_b long")
    got = {r["doc_id"]: r["group_id"] for r in components(pairs).collect()}
    assert got == {1: 1, 3: 1, 9: 1, 12: 1, 20: 20, 21: 20, 22: 20, 23: 20}
    assert components(pairs.where("doc_a > 99")).collect() == []


def test_exact_dedup(spark):
    rows = [(5, "a"), (3, "a"), (None, "a"), (4, "A"), (7, None), (8, None), (9, ""), (2, ""), (6, "b" * 100_000), (1, "b" * 100_000), (11, "c"), (11, "c")]
    df = frame(spark, rows)
    got = exact_dedup(df, salts=3)
    assert got.columns == ["doc_id", "text", "key", "h", "grams", "copies"]
    assert sorted((r["doc_id"], r["text"] and r["text"][:1], r["copies"]) for r in got.collect() if r["text"] is not None) == [(1, "b", 2), (2, "", 2), (3, "a", 3), (4, "A", 1), (11, "c", 2)]
    assert sorted(r["doc_id"] for r in got.collect() if r["text"] is None) == [7, 8]
    assert exact_dedup(df.where("false")).collect() == []
    assert {r["doc_id"]: r["copies"] for r in exact_dedup(frame(spark, [(None, "x"), (None, "x")])).collect()} == {None: 2}


def test_join_empty(spark):
    assert jaccard_join(frame(spark, []).where("false")).collect() == []


def test_many_short_texts(spark):
    df = spark.range(150_000).selectExpr("id as doc_id", "concat('w', id div 2, ' x') as text")
    got = jaccard_join(df, 1, 0.9)
    assert got.count() == 150_000 and got.where("class_id <> doc_id div 2 * 2 or links <> 0").isEmpty()


def test_a_group_of_many_near_copies(spark):
    r = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(700):
        x = list(base)
        for _ in range(3):
            x[r.randrange(60)] = f"z{r.randrange(400)}"
        rows.append((i, " ".join(x)))
    want = brute(rows, 2, 0.7)
    for part_bytes in (1 << 30, 60_000):
        assert sorted((tuple(x) for x in jaccard_join(frame(spark, rows), 2, 0.7, part_bytes=part_bytes).collect()), key=str) == want


def test_other_case_and_copies(spark):
    same, near = "a b c d e f g", "a b c d e f z"
    rows = [(3, same.upper() + "!"), (5, same), (7, same), (8, near), (9, near), (2, "x y z"), (4, "x y z"), (1, "X, y z"), (6, "p q r s"), (10, "p q r s"), (7, "p q r s"), (None, near), (None, "alone")]
    got = sorted((tuple(x) for x in jaccard_join(frame(spark, rows), 2, 0.5).collect()), key=str)
    assert got == brute(rows, 2, 0.5)
    assert {(3, 3, 2), (5, 3, 2), (7, 3, 2), (9, 3, 2), (4, 1, 1), (10, 6, 0), (None, 3, 2), (None, None, 0)} <= set(got)
