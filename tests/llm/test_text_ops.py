import base64
import random
import time

import pytest
import tiktoken

from trustloom.llm import _text, bpe
from trustloom.llm.decontaminate import decontaminate
from trustloom.llm.licenses import NOTICES, automaton, canonical, evaluate, license_scan, postfix, scan, tokens


def words(t):
    return [b for w in _text.words([t]) for b in w.text(0, len(w.hashes))]


def brute(rows, items, n, slop, least=5):
    found = {}
    docs = [(k, words(t)) for k, t in rows if k is not None and t]
    for i, t in items:
        if i is None or t is None:
            continue
        x = words(t)
        size = min(n, len(x))
        if size < least:
            continue
        for g in {tuple(x[a : a + size]) for a in range(len(x) - size + 1)}:
            for k, d in docs:
                exact = sum(tuple(d[a : a + size]) == g for a in range(len(d) - size + 1))
                near = sum(all(any(d[p] == g[o] for p in range(max(0, a + o - slop), min(len(d), a + o + slop + 1))) for o in range(size)) for a in range(-slop, len(d) + 1))
                if exact or near:
                    e, m = found.get((k, i), (0, 0))
                    found[k, i] = e + exact, m + near
    return found


def test_decontamination_against_brute_force(spark):
    r = random.Random(4)
    vocab = [f"v{i}" for i in range(25)]
    text = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(r.randrange(1, 14)))) for i in range(12)] + [(50, None), (None, "a b c d e f"), (51, ""), (52, "x x x x x x x x x")]
    rows = [(i, " ".join(text(r.randrange(0, 60)))) for i in range(30)]
    for i in range(12):
        w = items[i][1].split()
        if len(w) > 5:
            rows.append((100 + i, " ".join(text(5) + w + text(3)).upper() + "?"))
            w.insert(3, "zzz")
            rows.append((200 + i, " ".join(text(2) + w)))
            w[4], w[5] = w[5], w[4]
            rows.append((300 + i, "  ".join(w)))
    rows += [(400, None), (401, ""), (None, items[0][1]), (402, "x " * 30), (100, rows[30][1])]
    docs = spark.createDataFrame([(k, t, "s", 3) for k, t in rows], "doc_id long, text string, item_id string, postings int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for n, slop, chunk in ((6, 2, 1 << 20), (8, 1, 100)):
        got = {(g.doc_id, g.item_id): (g.exact_hits, g.near_hits) for g in decontaminate(docs, bench, n, slop, chunk_bytes=chunk).collect()}
        assert got == brute(rows, items, n, slop)
    assert decontaminate(docs.where("false"), bench).collect() == []
    assert decontaminate(docs, bench.where("false")).collect() == []


def test_expressions():
    run = lambda s: canonical(evaluate(postfix(tokens(s, 0))))
    assert run("MIT OR Apache-2.0 AND BSD-3-Clause") == "MIT OR Apache-2.0 AND BSD-3-Clause"
    assert run("(MIT OR Apache-2.0) AND BSD") == run("bsd".upper() + " and (Apache-2.0 or (MIT or MIT))") == "BSD AND (Apache-2.0 OR MIT)"
    assert run("GPL-2.0+ WITH Classpath-exception-2.0 or mit") == "GPL-2.0+ WITH Classpath-exception-2.0 OR mit"
    assert postfix(["MIT", "OR"]) is None and postfix(["(", "MIT"]) is None and postfix([]) is None
    assert evaluate(postfix(["(", "A", "OR", "B", ")", "WITH", "C"])) is None


def sets(x):
    """What an expression allows, expanded: the brute force for small ones."""
    if not x.op:
        return {frozenset([x.name])}
    parts = [sets(k) for k in x.kids.values()]
    if x.op == "or":
        return set().union(*parts)
    out = {frozenset()}
    for p in parts:
        out = {a | b for a in out for b in p}
    return out


def test_expressions_against_expansion():
    r = random.Random(2)

    def make(depth):
        if not depth or r.random() < 0.3:
            n = r.choice("ABCDE")
            return n, {frozenset([n])}
        a, b, op = *(make(depth - 1) for _ in "ab"), r.choice(["OR", "AND"])
        return f"({a[0]} {op} {b[0]})", a[1] | b[1] if op == "OR" else {x | y for x in a[1] for y in b[1]}

    for _ in range(300):
        text, want = make(4)
        x = evaluate(postfix(tokens(text, 0)))
        again = evaluate(postfix(tokens(canonical(x), 0)))
        assert sets(x) == want and canonical(again) == canonical(x) and again.choices == x.choices >= 1


def test_large_expressions_stay_small():
    began = time.time()
    for n in (30, 200, 3000):
        (found,) = scan("SPDX-License-Identifier: " + " AND ".join(f"(A{i} OR B{i})" for i in range(n)), automaton())
        assert found[2] and found[3] == min(2**n, 2**63 - 1) and len(found[1]) < 25 * n
    n = 20_000
    (found,) = scan("SPDX-License-Identifier: " + "".join(f"A{i} OR (B{i} AND (" for i in range(n)) + "X" + "))" * n, automaton())
    assert found[2:] == (True, n + 1)
    assert scan("\n# " * 300_000 + " " * 300_000 + " the mit license", automaton()) == [("notice", "MIT", True, 1)]
    assert time.time() - began < 20


def plain(text):
    """Notices by trying every pattern at every place."""
    text, out, at = text.lower(), [], 0
    while at < len(text):
        here = [p for p in NOTICES if text.startswith(p, at) and not (at and text[at - 1].isalnum()) and not text[at + len(p) : at + len(p) + 1].isalnum()]
        if here:
            out.append(NOTICES[max(here, key=len)])
            at += len(max(here, key=len))
        else:
            at += 1
    return out


def test_scan_against_every_pattern_at_every_place():
    r = random.Random(6)
    parts = [*NOTICES, "misc license", "gnu general", "x", "the", "the mit licenses", "licensed under cc by-nc", "(", ","]
    for _ in range(400):
        text = " ".join(r.choice(parts) for _ in range(r.randrange(1, 9)))
        text = "".join(c.upper() if r.random() < 0.3 else c for c in text)
        assert [f[1] for f in scan(text, automaton())] == plain(text)
    assert scan("misc license", automaton()) == [] and scan("MIT LICENSE; the isc license!", automaton()) == [("notice", "ISC", True, 1)]


def test_license_scan(spark):
    rows = [
        (1, "// SPDX-License-Identifier: MIT OR Apache-2.0\nint main"), (2, "SPDX-License-Identifier: (GPL-2.0 AND\n"), (3, "Licensed under the Apache License, Version 2.0. All rights reserved. ALL RIGHTS RESERVED"),
        (4, "nothing"), (5, None), (6, ""), (None, "the MIT license"), (7, "x " * 100_000 + "\u0130 SPDX-License-Identifier: MIT."), (4, "bsd 3-clause"),
    ]
    df = spark.createDataFrame([(k, t, "kind") for k, t in rows], "doc_id long, text string, kind string")
    got = sorted((tuple(r) for r in license_scan(df).collect()), key=str)
    assert got == sorted([
        (1, "tag", "Apache-2.0 OR MIT", True, 2, 1), (2, "tag", "( GPL-2.0", False, 0, 1), (3, "notice", "Apache-2.0", True, 1, 1), (3, "notice", "Proprietary", True, 1, 2),
        (None, "notice", "MIT", True, 1, 1), (7, "tag", "MIT", True, 1, 1), (4, "notice", "BSD-3-Clause", True, 1, 1),
    ], key=str)
    assert license_scan(df.where("false")).collect() == []


@pytest.fixture(scope="module")
def tok():
    with open(bpe.VOCABULARY, "rb") as f:
        lines = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
    return bpe.Vocabulary(lines), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(9)
    out = ["", "a", " a  b\n\n c\t", "hello world's I'll\n", "日本語テキスト 🎉🎉 x", "aaaa" * 300, "  \n x", "a b  c　", "tail ", "\0 nul \0\n", "12 345 6"]
    out += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 400), r.randrange(0x4E00, 0x4F00)])) for _ in range(r.randrange(300))) for _ in range(60)]
    return out + ["".join(r.choice("abcde fgh\n ' ") for _ in range(r.randrange(200))) for _ in range(200)]


def test_bpe_equals_the_tokenizer(tok):
    v, t = tok
    for most in (250_000, 5):
        e = bpe.Encoder(v, most)
        for lo in range(0, len(texts()), 37):
            part = texts()[lo : lo + 37]
            ids, ptr, ok = e.encode_checked(part)
            assert all(ok) and [ids[a:b].tolist() for a, b in zip(ptr, ptr[1:])] == [t.encode_ordinary(x) for x in part]


def test_bpe_column(spark, tok):
    rows = [(i, t) for i, t in enumerate(texts())] + [(900, None), (None, "x"), (3, "again"), (3, "again"), (901, "long " * 60_000)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, token_ids int")
    got = bpe.bpe_encode(df)
    want = sorted(repr((k, None if t is None else tok[1].encode_ordinary(t))) for k, t in rows)
    assert sorted(repr((r.doc_id, r.token_ids)) for r in got.collect()) == want
    assert {r.round_trip for r in got.where("n_tokens is not null").collect()} == {True}
    back = bpe.bpe_decode(got).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in back))) == sorted(map(repr, rows))
    assert bpe.bpe_encode(df.where("false")).collect() == []


def test_wrapped_notices():
    find = lambda t: [(f[0], f[1]) for f in scan(t, automaton())]
    assert find("the GNU General Public\nLicense") == [("notice", "GPL")]
    for sign in ("", "# ", " * ", "// ", "  ;; ", "-- ", "\t"):
        assert find(f"{sign}Licensed under the Apache  License,\n{sign}Version 2.0\r\n{sign}\n{sign}GNU General\r\n{sign}Public License,\n{sign}\n{sign}version 2") == [("notice", "Apache-2.0"), ("notice", "GPL-2.0")]
    assert find("x  y\n\n# z\n# SPDX-License-Identifier:  MIT OR Apache-2.0\n# the  MIT\n# license") == [("tag", "Apache-2.0 OR MIT"), ("notice", "MIT")]
    assert find("all # rights reserved") == []
