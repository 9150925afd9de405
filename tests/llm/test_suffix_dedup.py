import random

from hypothesis import given, settings
from hypothesis import strategies as st

from trustloom.llm import _text
from trustloom.llm.suffix_dedup import LoserTree, common_prefix, front_code, front_decode, suffix_dedup, words_in


def brute(rows, least):
    """(doc, start) of all windows that occur more than once."""
    seen = {}
    for k, t in rows:
        if k is None or t is None:
            continue
        for w in _text.words([t]):
            x = w.text(0, len(w.hashes))
            for i in range(len(x) - least + 1):
                seen.setdefault(tuple(x[i : i + least]), []).append((k, i))
    return {p for v in seen.values() if len(v) > 1 for p in v}


@given(st.lists(st.lists(st.text("ab ", max_size=12).map(str.encode), max_size=8), min_size=1, max_size=7))
@settings(max_examples=150, deadline=None)
def test_loser_tree_sorts_and_knows_prefixes(lists):
    runs = []
    for x in lists:
        x = sorted(x)
        runs.append([(s, common_prefix(x[i - 1], s) if i else 0, i) for i, s in enumerate(x)])
    got = list(LoserTree(runs))
    assert [g[0] for g in got] == sorted(s for x in lists for s in x)
    for a, b in zip(got, got[1:]):
        assert b[1] == common_prefix(a[0], b[0])


@given(st.lists(st.tuples(st.text("ab ", max_size=12).map(str.encode), st.integers(0, 9), st.integers(0, 9))))
@settings(deadline=None)
def test_front_coding(rows):
    rows = sorted(rows)
    assert [(s, *what) for s, _, what in front_decode(front_code(rows), len(rows))] == rows


def test_words_in():
    assert words_in(b"ab c", b"ab d", 3) == 1
    assert words_in(b"ab c", b"abc d", 2) == 0
    assert words_in(b"ab", b"ab d", 2) == 1


def test_against_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, other = text(20), text(9)
    rows = [(i, text(r.randrange(0, 60))) for i in range(30)]
    rows += [(100 + i, f"{text(r.randrange(9))} {passage} {text(5)}") for i in range(4)]
    rows += [(200, passage.upper() + "! " + other), (201, other + " " + other), (202, rows[5][1]), (203, rows[5][1]), (204, "x y " * 40)]
    rows += [(300, None), (None, passage), (301, ""), (302, passage), (302, passage), (303, " ".join(passage.split()[:11]))]
    df = spark.createDataFrame([(k, t, "z", 1) for k, t in rows], "doc_id long, text string, block string, t int")
    got = suffix_dedup(df, least=8).collect()
    covered = {(g.doc_id, g.start + i) for g in got for i in range(g.n_words - 7)}
    assert covered == brute(rows, 8)
    by = {}
    for k, t in rows:
        if t:
            by.setdefault(k, []).append(next(iter(_text.words([t]))))
    for g in got:
        left = [w.text(g.start, g.start + g.n_words) for w in by[g.doc_id]]
        right = [w.text(g.other_start, g.other_start + g.n_words) for w in by[g.other_id]]
        assert any(x in right for x in left) and len(left[0]) == g.n_words


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup(df).collect() == []


def test_left_neighbours_that_agree_in_some_bits(spark):
    seen = {}
    for i in range(100_000):
        bits = _text.word_hash(f"left{i}") >> 48 | 1
        if bits in seen:
            break
        seen[bits] = i
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(1, f"a left{seen[bits]} {passage} b"), (2, f"c left{i} {passage} d"), (3, f"e left{i} {passage} f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup(df, least=8).collect()
    assert {(g.doc_id, g.start + k) for g in got for k in range(g.n_words - 7)} == brute(rows, 8)
