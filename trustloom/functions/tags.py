"""Tags: parsing their JSON, edges, and predicates on events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import COMMENT, NOTE

#: What parse_tags gives: values are bytes until a dictionary numbers them.
PARSED = "array<struct<label: string, value: binary, address: binary, amount: bigint>>"


def hex32(v: Column) -> Column:
    """The 32 bytes of 64 hexadecimal digits of either case, else null."""
    return F.when(F.length(v) == 64, F.try_to_binary(v, F.lit("hex")))


def d_value(v: Column) -> Column:
    """The bytes of a d tag: 64 hexadecimal digits are decoded, so that they equal an id."""
    return F.coalesce(hex32(v), F.encode(v, "utf-8"))


def invoice_amount(v: Column) -> Column:
    """Satoshis of a BOLT11 invoice: 0 without an amount, null if it isn't an invoice.

    The form is checked, not the checksum or the signature.
    """
    low = F.lower(v)
    shape = r"^ln(?:bcrt|bc|tbs|tb)(?:([1-9][0-9]*)([munp]?))?1[02-9ac-hj-np-z]{110,}$"
    digits, unit = F.regexp_extract(low, shape, 1), F.regexp_extract(low, shape, 2)
    n = digits.try_cast("decimal(38,0)")
    # millisatoshis of a unit; a pico-bitcoin is a tenth of one
    msat = (
        F.when(unit == "m", n * 100_000_000)
        .when(unit == "u", n * 100_000)
        .when(unit == "n", n * 100)
        .when(unit == "p", F.when(n % 10 == 0, F.floor(n / 10)))
        .otherwise(n * 100_000_000_000)
    )
    ok = low.rlike(shape) & ((v == low) | (v == F.upper(v)))
    return F.when(ok, F.when(digits == "", F.lit(0).cast("bigint")).otherwise(F.floor(msat / 1000).try_cast("bigint")))


def _tag(label: str | Column, value: Column | None = None, address: Column | None = None, amount: Column | None = None) -> Column:
    none = F.lit(None)
    return F.struct(
        (F.lit(label) if isinstance(label, str) else label).alias("label"),
        (none if value is None else value).cast("binary").alias("value"),
        (none if address is None else address).cast("binary").alias("address"),
        (none if amount is None else amount).cast("bigint").alias("amount"),
    )


def _one(t: Column) -> Column:
    """The tag of an array of strings, null if there's none in it."""
    name, v = F.get(t, F.lit(0)), F.get(t, F.lit(1))
    marker = F.get(t, F.lit(3))
    id_ = hex32(v)
    parts = F.split(v, ":", 3)
    owner = F.when(F.size(parts) == 3, hex32(F.get(parts, F.lit(1))))
    reply = F.when(marker == "reply", "Reply").when(marker == "root", "RootReply").otherwise("Mention")
    amount = invoice_amount(v)

    def if_there(x: Column, tag: Column) -> Column:
        return F.when(x.isNotNull(), tag)

    return (
        F.when((F.size(t) < 2) | v.isNull() | name.isNull(), None)
        .when(name == "e", if_there(id_, _tag(reply, id_)))
        .when(name == "p", if_there(id_, _tag("Pubkey", id_)))
        .when(name == "P", if_there(id_, _tag("PubkeyUpper", id_)))
        .when((name == "q") & v.contains(":"), if_there(owner, _tag("QuoteAddress", owner, F.encode(v, "utf-8"))))
        .when(name == "q", if_there(id_, _tag("Quote", id_)))
        .when(name == "a", if_there(owner, _tag("Address", owner, F.encode(v, "utf-8"))))
        .when(name == "t", _tag("Topic", F.encode(F.lower(v), "utf-8")))
        .when(name == "d", _tag("DTag", d_value(v)))
        .when(name == "bolt11", if_there(amount, _tag("Bolt11", amount=amount)))
    )


def parse_tags(json: Column, strict: bool = True) -> Column:
    """Tags of a JSON array of arrays of strings, in order; unknown and malformed ones are dropped.

    strict: one element that isn't a string, or one backslash escape, empties
    the whole list. Otherwise numbers and the like count as their text.
    """
    lists = F.from_json(json, "array<array<string>>")
    lists = F.coalesce(lists, F.array().cast("array<array<string>>"))
    if strict:
        # without escapes the list is exactly what writing it again gives, but for white space
        bare = F.regexp_replace(json, r'"[^"]*"', '""')
        fine = ~json.contains("\\") & bare.rlike(r'^\s*\[\s*(\[\s*(""\s*(,\s*""\s*)*)?\]\s*(,\s*\[\s*(""\s*(,\s*""\s*)*)?\]\s*)*)?\]\s*$')
        lists = F.when(fine, lists).otherwise(F.array().cast("array<array<string>>"))
    return F.filter(F.transform(lists, _one), lambda x: x.isNotNull()).cast(PARSED)


def labelled(tags: Column, *labels: str) -> Column:
    return F.filter(tags, lambda t: t["label"].isin(*labels))


def first_node(tags: Column, label: str) -> Column:
    return F.get(labelled(tags, label), F.lit(0))["node"]


def last_amount(tags: Column) -> Column:
    some = labelled(tags, "Bolt11")
    return F.get(some, F.size(some) - 1)["amount"]


def is_note(kind: Column) -> Column:
    return kind == NOTE


def is_reply(kind: Column, tags: Column) -> Column:
    """A comment, or an event of any kind that names what it replies to."""
    return (kind == COMMENT) | F.coalesce(F.exists(tags, lambda t: t["label"].isin("Reply", "RootReply")), F.lit(False))


def is_root_post(kind: Column, tags: Column) -> Column:
    return is_note(kind) & ~is_reply(kind, tags)
