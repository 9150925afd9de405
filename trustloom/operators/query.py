"""Conjunctive event filters over the numbered store and over the text store."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import hex32
from ..schema import LABELS, QUERY_LIMIT

#: What each letter of a filter stands for.
LETTERS = {
    "e": ("Reply", "RootReply", "Mention"), "E": ("Mention",), "p": ("Pubkey",), "P": ("PubkeyUpper",), "t": ("Topic",),
    "q": ("Quote",), "a": ("Address",), "A": ("Address",), "d": ("DTag",),
}
#: Letters that compat filters know in their predicate.
_COMPAT = {"e": ("Reply", "RootReply", "Mention", "Quote"), "p": ("Pubkey", "PubkeyUpper"), "t": ("Topic",), "d": ("DTag",)}


def _has(*fields: tuple[str, Iterable]) -> Callable[[Column], Column]:
    return lambda t: reduce(lambda a, b: a & b, [t[name].isin(*values) for name, values in fields])


def _is_tag(letter: str, values: list[str]) -> Callable[[Column], Column]:
    return lambda t: (F.get(t, F.lit(0)) == letter) & F.get(t, F.lit(1)).isin(*values)


def _add(have: frozenset | None, more: Iterable) -> frozenset:
    return (have or frozenset()) | frozenset(more)


@dataclass(frozen=True)
class Filter:
    """All conditions must hold; within one, and within the values of a tag letter, any may. Bounds include."""

    ids: frozenset = frozenset()
    authors: frozenset = frozenset()
    kinds: frozenset = frozenset()
    tags: dict[str, frozenset] = field(default_factory=dict)
    since: int | None = None
    until: int | None = None
    limit: int | None = None

    def with_ids(self, *ids) -> Filter:
        return replace(self, ids=_add(self.ids, ids))

    def with_authors(self, *authors) -> Filter:
        return replace(self, authors=_add(self.authors, authors))

    def with_kinds(self, *kinds: int) -> Filter:
        return replace(self, kinds=_add(self.kinds, kinds))

    def with_tags(self, letter: str, *values) -> Filter:
        return replace(self, tags={**self.tags, letter: _add(self.tags.get(letter), values)})

    def between(self, since: int | None = None, until: int | None = None) -> Filter:
        return replace(self, since=since, until=until)

    def with_limit(self, limit: int | None) -> Filter:
        return replace(self, limit=limit or None)

    @property
    def index(self) -> str:
        return "ids" if self.ids else "tags" if self.tags else "authors" if self.authors else "kinds" if self.kinds else "none"

    def tag_keys(self) -> list[tuple[str, object]]:
        return sorted((label, v) for letter, values in self.tags.items() for label in LETTERS.get(letter, ()) for v in values)

    def predicate(self, compat: bool = False) -> Column:
        parts = []
        for column, values in (("id", self.ids), ("pubkey", self.authors), ("kind", self.kinds)):
            if values:
                parts.append(F.col(column).isin(*sorted(values)))
        if self.since is not None:
            parts.append(F.col("created_at") >= self.since)
        if self.until is not None:
            parts.append(F.col("created_at") <= self.until)
        for letter, values in self.tags.items():
            labels = (_COMPAT if compat else LETTERS).get(letter, ())
            if not labels:
                if compat:
                    parts.append(F.lit(False))
                continue
            parts.append(F.exists("tags", _has(("label", labels), ("node", sorted(values)))))
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def run(events: DataFrame, f: Filter, order: str = "index", compat: bool = False) -> DataFrame:
    """Events of a filter, at most its limit (QUERY_LIMIT without one).

    order index keeps the lowest keys of the index that serves the filter, then
    the lowest ids; created_at_desc keeps the newest. compat gives nothing for
    a filter without ids, tags, authors and kinds, or with a letter other than
    e, p, t and d.
    """
    rows = events.where(f.predicate(compat))
    if compat and f.index == "none":
        rows = rows.where(F.lit(False))
    if order == "created_at_desc":
        keys = [F.desc("created_at"), F.asc("id")]
    elif f.index == "tags":
        wanted = f.tag_keys()
        pairs = [F.struct(F.lit(LABELS[label]).alias("l"), F.lit(v).cast("bigint").alias("n")) for label, v in wanted]
        place = F.create_map(*[x for k, v in LABELS.items() for x in (F.lit(k), F.lit(v))])
        mine = F.transform("tags", lambda t: F.struct(place[t["label"]].alias("l"), t["node"].alias("n")))
        rows = rows.withColumn("_key", F.array_min(F.filter(mine, lambda t: F.array_contains(F.array(*pairs), t)))) if pairs else rows.withColumn("_key", F.lit(0))
        keys = [F.asc("_key"), F.asc("id")]
    else:
        keys = [F.asc({"authors": "pubkey", "kinds": "kind"}.get(f.index, "id")), F.asc("id")]
    return rows.orderBy(*keys).limit(f.limit or QUERY_LIMIT).drop("_key")


def from_text(f: Filter, dictionary: DataFrame) -> Filter | None:
    """A filter of hexadecimal ids and texts in dictionary numbers; None if a condition names nothing that is known.

    Unknown values of a condition that also has known ones are dropped, as are
    unknown tag letters. Topics are looked up in lower case.
    """
    wanted: list[tuple[str, str, bytes | None]] = []

    def raw(v: str) -> bytes | None:
        try:
            return bytes.fromhex(v) if len(v) == 64 else None
        except ValueError:
            return None

    def owner(v: str) -> bytes | None:
        parts = v.split(":", 2)
        return raw(parts[1]) if len(parts) == 3 else raw(v)

    for v in f.ids:
        wanted.append(("ids", v, raw(v)))
    for v in f.authors:
        wanted.append(("authors", v, raw(v)))
    for letter, values in f.tags.items():
        for v in values if letter in LETTERS else ():
            b = v.lower().encode() if letter == "t" else (raw(v) or v.encode()) if letter == "d" else owner(v) if letter in "aA" else raw(v)
            wanted.append((letter, v, b))
    some = [b for _, _, b in wanted if b is not None]
    known = {bytes(r["bytes"]): r["sym"] for r in dictionary.where(F.col("bytes").isin(*some)).collect()} if some else {}
    found: dict[str, set] = {}
    for where, _, b in wanted:
        found.setdefault(where, set())
        if b in known:
            found[where].add(known[b])
    if any(not v for v in found.values()):
        return None
    return Filter(frozenset(found.get("ids", ())), frozenset(found.get("authors", ())), f.kinds, {k: frozenset(v) for k, v in found.items() if k not in ("ids", "authors")}, f.since, f.until, f.limit or None)


# The text store: id, pubkey, created_at, kind, tags (JSON), content, sig, ids in hexadecimal.


def _lists(c: str = "tags") -> Column:
    return F.from_json(c, "array<array<string>>")


def valid_rows(store: DataFrame) -> DataFrame:
    """Rows that are events: hexadecimal of the right length, tags a list of lists."""
    return store.where(hex32(F.col("id")).isNotNull() & hex32(F.col("pubkey")).isNotNull() & _lists().isNotNull())


def by_ids(store: DataFrame, ids: list[str]) -> DataFrame:
    return store.where(F.col("id").isin(*ids)).orderBy(F.desc("created_at"), "id")


def latest_replaceable(store: DataFrame, author: str, kind: int) -> DataFrame:
    return store.where((F.col("pubkey") == author) & (F.col("kind") == kind)).orderBy(F.desc("created_at"), "id").limit(1)


def latest_addressable(store: DataFrame, author: str, kind: int, d: str) -> DataFrame:
    """Any d tag may be the one."""
    mine = F.exists(_lists(), lambda t: (F.get(t, F.lit(0)) == "d") & (F.get(t, F.lit(1)) == d))
    return store.where((F.col("pubkey") == author) & (F.col("kind") == kind) & mine).orderBy(F.desc("created_at"), "id").limit(1)


def by_tags(store: DataFrame, pairs: list[tuple[str, str]], limit: int | None = None) -> DataFrame:
    """Events with any of the (name, value) tags, newest first."""
    has = F.exists(_lists(), lambda t: reduce(lambda a, b: a | b, [(F.get(t, F.lit(0)) == k) & (F.get(t, F.lit(1)) == v) for k, v in pairs], F.lit(False)))
    return store.where(has).orderBy(F.desc("created_at"), "id").limit(limit or QUERY_LIMIT)


def query_store(store: DataFrame, f: Filter) -> DataFrame:
    """A filter over the text store, newest first; an empty time range is an error."""
    if f.since is not None and f.until is not None and f.since > f.until:
        raise ValueError("since lies after until")
    cond = replace(f, tags={}).predicate()
    for letter, values in f.tags.items():
        cond &= F.exists(_lists(), _is_tag(letter, sorted(values)))
    return store.where(cond).orderBy(F.desc("created_at"), "id").limit(f.limit or QUERY_LIMIT)


def count_store(store: DataFrame, f: Filter) -> DataFrame:
    return query_store(store, f).agg(F.count("*").alias("n"))


def to_json(events: DataFrame) -> DataFrame:
    """Events as their JSON; tags that aren't a list of lists are an empty one."""
    tags = F.coalesce(_lists(), F.array().cast("array<array<string>>"))
    hexed = lambda c: F.lower(F.hex(c)) if dict(events.dtypes)[c] == "binary" else F.col(c)
    fields = [hexed(c).alias(c) if c in ("id", "pubkey", "sig") else tags.alias(c) if c == "tags" else F.col(c) for c in ("id", "pubkey", "created_at", "kind", "tags", "content", "sig")]
    return events.select(F.to_json(F.struct(*fields)).alias("event"))
