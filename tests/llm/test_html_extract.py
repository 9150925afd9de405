import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from trustloom.llm import _text
from trustloom.llm.html_extract import extract, longest_shared, suffix_array, visible_text

SCHEMA = "page_id long, url string, html string, block string"


def brute(rows, least):
    """page -> token flags that stay, with the tokens."""
    host = lambda k, u: (u or "").split("/")[2].lower() if "//" in (u or "") else f"#{k}"
    seen, pages = {}, []
    for k, u, h, _ in rows:
        if k is None:
            continue
        x = [b for w in _text.words([visible_text(h or "")], lower=False) for b in w.text(0, len(w.hashes))]
        pages.append((k, host(k, u), x))
        for i in range(len(x) - least + 1):
            seen.setdefault((host(k, u), tuple(x[i : i + least])), set()).add(k)
    out = []
    for k, h, x in pages:
        keep = [True] * len(x)
        for i in range(len(x) - least + 1):
            if len(seen[h, tuple(x[i : i + least])]) > 1:
                keep[i : i + least] = [False] * least
        out.append((k, [b.decode() for b, s in zip(x, keep) if s], len(x), keep.count(False)))
    return sorted(out)


def rows_of(r):
    words = [f"W{i}" for i in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    nav, foot = text(9), text(14)
    rows = []
    for i in range(40):
        h = ["http://a.com/x", "https://B.com", "http://a.com:80/y?z=//q", "ftp://u@c.org/"][i % 4]
        rows.append((i, h, f"<nav>{nav}</nav><p>{text(r.randrange(40))}.<p>{text(12)}<footer>{foot}</footer>", "x"))
    rows += [(100, None, nav + foot, "x"), (101, "nonsense", nav, "x"), (102, "http://a.com", None, None), (103, "http://a.com", "", "")]
    rows += [(104, "http://d.net/1", "<p>" + text(30), "x"), (None, "http://a.com", nav, "x")]
    rows += [(105, "http://e.net/1", f"<p>{foot} {foot}", "x")] * 2  # a page twice isn't two pages
    return rows


def test_against_brute_force(spark):
    rows = rows_of(random.Random(5))
    df = spark.createDataFrame(rows, SCHEMA)
    for block_bytes in (1 << 20, 700):  # one block, and hosts cut over many
        got = sorted((g.page_id, [b.decode() for w in _text.words([g.text], lower=False) for b in w.text(0, len(w.hashes))], g.n_tokens, g.n_removed) for g in extract(df, least=6, block_bytes=block_bytes).collect())
        assert got == brute(rows, 6)


def test_visible_text():
    assert visible_text('<head><title>t</title></head><script>var t="</p>";</script><p a="x>y">A &amp; <b>b</b>old<br>c <!-- d -->1 < 2') == "A & bold\nc 1 < 2"
    assert visible_text("<script>never closed <p>x") == ""
    for hidden in ("svg", "iframe", "template", "script"):
        assert visible_text(f"<p>a</p><{hidden}/><p>b</p><{hidden} x='>' />c<{hidden}>d</{hidden.upper()} >e") == "a\nb\nc e"
    assert visible_text('a <b title="x>y" <i>c</i> d < e <f "g>h') == 'a y" c d < e h'
    assert visible_text("a <!-- b <p> c --> d <!-- e > f") == "a d" and visible_text("a <b c <!-- d") == "a <b c"
    assert visible_text("<pre>x</pre>y<?php z ?>w</ q>!") == "x\nyw!"


def test_malformed_pages_take_linear_time():
    began = time.time()
    n = 250_000
    parts = ["<a", "<a ", "<!--", '<a "', "<a '>", '<a ">" ', "<svg", "<svg>", "</", "<", '"<a>"', "<script/>", "<b x='", "<p>", "&amp"]
    for x in parts:
        for end in ("", '"', ">", "'>", "-->"):
            visible_text(x * (n // len(x)) + end)
    assert time.time() - began < 60


@given(st.lists(st.lists(st.integers(0, 3), max_size=14), min_size=1, max_size=7), st.lists(st.integers(0, 2), min_size=7, max_size=7))
@settings(max_examples=300, deadline=None)
def test_suffix_array(streams, pages):
    flat = np.array([x for s in streams for x in s], np.uint64)
    end = np.repeat(np.cumsum([len(s) for s in streams]), [len(s) for s in streams])
    page = np.repeat(np.array(pages[: len(streams)]), [len(s) for s in streams])
    suffix = [tuple(flat[i:e].tolist()) for i, e in enumerate(end)]

    def common(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    order, lcp = suffix_array(flat, end)
    assert [suffix[i] for i in order] == sorted(suffix) and sorted(order.tolist()) == list(range(len(flat)))
    assert lcp.tolist() == [common(suffix[order[k - 1]], suffix[i]) if k else 0 for k, i in enumerate(order)]
    assert longest_shared(flat, end, page).tolist() == [max((common(s, t) for t, q in zip(suffix, page) if q != p), default=0) for s, p in zip(suffix, page)]


def test_empty(spark):
    assert extract(spark.createDataFrame([], SCHEMA)).collect() == []
