"""License scans (operator 8).

One Aho-Corasick pass finds identifier tags and notice phrases; a
shunting-yard parser turns the expression after a tag into postfix order and
evaluates it into what a user may choose from, without expanding it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGS = ("spdx-license-identifier:", "license-expression:")
#: choices are counted up to here.
MOST = (1 << 63) - 1
#: Notice phrases, lower case with single spaces, and the licence each names.
NOTICES = {
    "permission is hereby granted, free of charge": "MIT",
    "licensed under the mit license": "MIT",
    "released under the mit license": "MIT",
    "the mit license": "MIT",
    "licensed under the apache license, version 2.0": "Apache-2.0",
    "apache license, version 2.0": "Apache-2.0",
    "apache license version 2.0": "Apache-2.0",
    "redistribution and use in source and binary forms": "BSD",
    "licensed under the bsd": "BSD",
    "bsd 3-clause": "BSD-3-Clause",
    "bsd 2-clause": "BSD-2-Clause",
    "gnu general public license": "GPL",
    "gnu general public license, version 2": "GPL-2.0",
    "gnu general public license, version 3": "GPL-3.0",
    "gnu general public license version 2": "GPL-2.0",
    "gnu general public license version 3": "GPL-3.0",
    "licensed under cc by 4.0": "CC-BY-4.0",
    "licensed under cc by-sa 4.0": "CC-BY-SA-4.0",
    "licensed under cc by-nc 4.0": "CC-BY-NC-4.0",
    "licensed under cc0": "CC0-1.0",
    "gnu lesser general public license": "LGPL",
    "gnu affero general public license": "AGPL",
    "mozilla public license": "MPL-2.0",
    "creative commons attribution": "CC-BY",
    "licensed under cc by-sa": "CC-BY-SA",
    "licensed under cc by": "CC-BY",
    "licensed under a creative commons": "CC",
    "all rights reserved": "Proprietary",
    "eclipse public license": "EPL",
    "boost software license": "BSL-1.0",
    "isc license": "ISC",
    "the unlicense": "Unlicense",
}
_TOKEN = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
#: White space other than a single space, with the comment signs that open its lines.
_GAP = re.compile(r"(?= \s|[^\S ])(?:[^\S\r\n]++|[\r\n]++(?:[^\S\r\n]*+(?:/\*+|\*+|//+[/!]?|#+|;+|--+|%+|<!--|\.\.|dnl\b|rem\b|>+|!+|'+|\"\"\"|\|+))?)++")
#: Every pattern has one of these words, whole, as words have no gaps.
_ANCHORS = {max(p.split(), key=len) for p in (*TAGS, *NOTICES)}
_ANCHORS = sorted(a for a in _ANCHORS if not any(b in a for b in _ANCHORS - {a}))
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: Stands for a null key in pandas, which would turn a column with nulls into floats.
_NONE = -(1 << 63)
FOUND = "doc_id bigint, kind string, license string, valid boolean, choices bigint, hits bigint"


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for t in TAGS:
        a.add_word(t, (t, None))
    for p, name in NOTICES.items():
        a.add_word(p, (p, name))
    a.make_automaton()
    return a


def tokens(text: str, at: int) -> list[str]:
    """The tokens of the expression that starts at text[at], up to what can't continue it."""
    out: list[str] = []
    depth, operand = 0, False
    while m := _TOKEN.match(text, at):
        t = m[1]
        op = t.lower() in _PRECEDENCE
        if t == "(":
            if operand:
                break
            depth += 1
        elif t == ")":
            if not depth or not operand:
                break
            depth -= 1
        elif op:
            if not operand:
                break
            operand = False
        else:
            if operand:
                break
            operand = True
        out.append(t)
        at = m.end()
    return out


def postfix(infix: list[str]) -> list[str] | None:
    """Shunting yard; None for what isn't an expression."""
    out: list[str] = []
    stack: list[str] = []
    operand = False
    for t in infix:
        low = t.lower()
        if t == "(":
            if operand:
                return None
            stack.append(t)
        elif t == ")":
            if not operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif low in _PRECEDENCE:
            if not operand:
                return None
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        else:
            if operand:
                return None
            out.append(t)
            operand = True
    if not operand:
        return None
    while stack:
        if stack[-1] == "(":
            return None
        out.append(stack.pop())
    return out


class Expression:
    """A licence, or the alternatives (or) or parts (and) of a larger expression, each of them once.

    digest depends on what the expression says, not on the order or nesting in
    which it says it. choices: the ways to choose one of each `or`, at most MOST.
    """

    __slots__ = ("op", "name", "kids", "_digest", "_choices")

    def __init__(self, op: str, name: str = "", kids: dict[bytes, Expression] | None = None):
        self.op, self.name, self.kids = op, name, kids or {}
        self._digest: bytes | None = None
        self._choices = 1

    def close(self) -> None:
        """Digest and choices, when nothing is added any more."""
        if self._digest is None:
            h = hashlib.blake2b(f"{self.op}\0{self.name}\0".encode(), digest_size=16)
            for d in sorted(self.kids):
                h.update(d)
            self._digest, self._choices = h.digest(), 1
            if self.op == "or":
                self._choices = min(sum(k.choices for k in self.kids.values()), MOST)
            for k in self.kids.values() if self.op == "and" else ():
                self._choices = min(self._choices * k.choices, MOST)

    @property
    def digest(self) -> bytes:
        self.close()
        return self._digest

    @property
    def choices(self) -> int:
        self.close()
        return self._choices

    def add(self, kids: dict[bytes, Expression]) -> None:
        self.kids.update(kids)
        self._digest = None


def _joined(op: str, a: Expression, b: Expression) -> Expression:
    """a op b; nothing is expanded, so the size is that of both."""
    if a.op == b.op == op:
        if len(a.kids) < len(b.kids):
            a, b = b, a
        a.add(b.kids)
        return a
    for x, y in ((a, b), (b, a)):
        if x.op == op:
            x.add({y.digest: y})
            return x
    x = Expression(op, "", {a.digest: a, b.digest: b})
    return a if len(x.kids) == 1 else x


def evaluate(rpn: list[str]) -> Expression | None:
    """What the expression allows; None if `with` joins more than names."""
    stack: list[Expression] = []
    for t in rpn:
        if t not in _PRECEDENCE:
            stack.append(Expression("", t))
            continue
        b, a = stack.pop(), stack.pop()
        if t != "with":
            stack.append(_joined(t, a, b))
        elif a.op or b.op:
            return None
        else:
            stack.append(Expression("", f"{a.name} WITH {b.name}"))
    return stack[0]


def canonical(x: Expression) -> str:
    """Names in sorted order, then what is compound by its digest; `and` binds closer than `or`."""
    out: list[str] = []
    todo: list[Expression | str] = [x]
    while todo:
        now = todo.pop()
        if isinstance(now, str):
            out.append(now)
        elif not now.op:
            out.append(now.name)
        else:
            parts: list[Expression | str] = []
            for d in sorted(now.kids, key=lambda d: (bool(now.kids[d].op), now.kids[d].name, d)):
                kid = now.kids[d]
                parts += [f" {now.op.upper()} "] if parts else []
                parts += ["(", kid, ")"] if now.op == "and" and kid.op == "or" else [kid]
            todo += reversed(parts)
    return "".join(out)


def collapse(low: str) -> tuple[str, list[int], list[int]]:
    """low with one space for each gap; where in it pieces begin that differ in offset, and there in low."""
    out: list[str] = []
    new, old = [0], [0]
    at = size = 0
    for m in _GAP.finditer(low):
        lo, hi = m.span()
        out += low[at:lo], " "
        size += lo - at + 1
        at = hi
        new.append(size)
        old.append(hi)
    out.append(low[at:])
    return "".join(out), new, old


def _matches(flat: str, machine: ahocorasick.Automaton) -> list[tuple[int, str, str | None]]:
    """(end, pattern, licence): whole words only; of those that overlap the first, of those that begin together the longest."""
    found = []
    for end, (pattern, name) in machine.iter(flat):
        begin = end - len(pattern) + 1
        if begin and flat[begin - 1].isalnum() or name is not None and end + 1 < len(flat) and flat[end + 1].isalnum():
            continue
        found.append((begin, -end, pattern, name))
    found.sort(key=itemgetter(0, 1))
    out, last = [], -1
    for begin, end, pattern, name in found:
        if begin > last:
            last = -end
            out.append((last, pattern, name))
    return out


def scan(text: str, machine: ahocorasick.Automaton) -> list[tuple[str, str, bool, int]]:
    """(kind, licence, valid, choices) of every find, in order."""
    low = text.replace("\u0130", "i").lower()  # the only letter whose lower case is longer
    if not any(a in low for a in _ANCHORS):
        return []
    found = []
    flat, new, old = collapse(low)
    for end, _, name in _matches(flat, machine):
        if name is not None:
            found.append(("notice", name, True, 1))
            continue
        piece = bisect_right(new, end) - 1  # a pattern ends in a letter or sign, never in a gap
        infix = tokens(text, old[piece] + end - new[piece] + 1)
        while infix and infix[-1].lower() in _PRECEDENCE:  # "MIT and" at the end of a sentence
            infix.pop()
        if infix and infix[-1] not in "()":
            infix[-1] = infix[-1].rstrip(".:") or infix[-1]
        rpn = postfix(infix)
        x = evaluate(rpn) if rpn else None
        if x is None:
            found.append(("tag", " ".join(infix), False, 0))
        else:
            found.append(("tag", canonical(x), True, x.choices))
    return found


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, license, valid, choices, hits): what each document declares.

    kind is tag or notice. An expression is given in a normal form: nested
    parts of one kind are one, repeats are left out, names come in sorted order;
    choices counts the ways to choose one of each OR, up to 2^63 - 1. Nothing is
    expanded, so size and time follow the text. One that can't be parsed has
    valid false, choices 0 and its tokens as license. Notices and tags are found
    as whole words ("misc license" isn't ISC) and may be wrapped, indented or
    commented: white space, and the comment signs at the beginnings of lines,
    count as one space. Matches don't overlap: the first counts, and of those
    that begin together the longest.
    hits counts repeats within a document; repeated rows of a key count
    together. Null and empty texts declare nothing; a null key is reported as
    null. Only the two named columns are read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = automaton()
        for pdf in batches:
            out = [(k, *f, 1) for k, t in zip(pdf["k"], pdf["t"]) if t for f in scan(t, machine)]
            yield pd.DataFrame(out, columns=["doc_id", "kind", "license", "valid", "choices", "hits"])

    return (
        docs.select(F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(_NONE)).alias("k"), F.col(f"`{text}`").alias("t"))
        .mapInPandas(run, FOUND)
        .withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(_NONE)))
        .groupBy("doc_id", "kind", "license", "valid", "choices")
        .agg(F.sum("hits").alias("hits"))
    )
