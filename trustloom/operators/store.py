"""Current state of events: de-duplication, last writer wins, deletes, change rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags
from .relational import changes

ORDER = ("_lsn", "_seq")


def is_replaceable(kind: Column) -> Column:
    return kind.isin(0, 3) | kind.between(10_000, 19_999)


def is_addressable(kind: Column) -> Column:
    return kind.between(30_000, 39_999)


def dedup_ids(events: DataFrame, *order: str) -> DataFrame:
    """The first of the rows of an id."""
    w = Window.partitionBy("id").orderBy(*order)
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest(rows: DataFrame, keys: list[str], newest: str, *order: str, tie: str = "old") -> DataFrame:
    """Of rows of a key that of the largest `newest`; ties go to the first in order, or with tie new to the last."""
    w = Window.partitionBy(*keys).orderBy(F.desc(newest), *[F.desc(c) if tie == "new" else F.asc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def d_tag(events: DataFrame) -> Column:
    """What the first d tag holds."""
    field = "node" if "node" in events.schema["tags"].dataType.elementType.names else "value"
    return F.get(tags.labelled(F.col("tags"), "DTag"), F.lit(0))[field].cast("string")


def slot(events: DataFrame) -> Column:
    """What an event competes for: its replaceable or addressable key, else null."""
    kind, d = F.col("kind"), d_tag(events)
    who = F.coalesce(F.col("pubkey").cast("string"), F.lit(""))
    return F.when(is_replaceable(kind), F.concat_ws(":", kind, who)).when(is_addressable(kind) & d.isNotNull(), F.concat_ws(":", kind, who, d))


def current(events: DataFrame, *order: str, tie: str = "old") -> DataFrame:
    """Survivors of inserts only: the first row of an id, the latest of a slot."""
    rows = dedup_ids(events, *order).withColumn("_slot", slot(events))
    free = rows.where(F.col("_slot").isNull())
    return free.unionByName(latest(rows.where(F.col("_slot").isNotNull()), ["_slot"], "created_at", *order, tie=tie)).drop("_slot")


def fold(rows: DataFrame, *order: str, tie: str = "old") -> DataFrame:
    """Survivors of inserts (_diff 1) and deletes (_diff -1), applied in order within each slot.

    A delete removes its id if that is stored; what it had replaced doesn't
    come back. An id counts once until it is deleted. Rows of one slot, or of
    one id outside slots, are folded by a higher-order function over their
    sorted list: one shuffle, no Python.
    """
    cols = [c for c in rows.columns if c != "_diff"]
    keyed = rows.withColumn("_slot", F.coalesce(slot(rows), F.concat(F.lit("id:"), F.col("id").cast("string"))))
    step = F.struct(*[F.col(c) for c in order], F.col("_diff").alias("diff"), F.struct(*cols).alias("row"))
    lists = keyed.groupBy("_slot").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    row_type = lists.schema["steps"].dataType.elementType["row"].dataType

    def apply(now: Column, s: Column) -> Column:
        newer = s["row"]["created_at"] > now["created_at"] if tie == "old" else s["row"]["created_at"] >= now["created_at"]
        same = s["row"]["id"] == now["id"]
        return (
            F.when((s["diff"] > 0) & now.isNull(), s["row"])
            .when((s["diff"] > 0) & ~same & newer, s["row"])
            .when((s["diff"] < 0) & now.isNotNull() & same, F.lit(None).cast(row_type))
            .otherwise(now)
        )

    state = F.aggregate("steps", F.lit(None).cast(row_type), apply)
    return lists.select(state.alias("row")).where(F.col("row").isNotNull()).select("row.*")


def change_log(before: DataFrame, after: DataFrame) -> DataFrame:
    return changes(before, after)


def engagement_weight(events: DataFrame) -> DataFrame:
    """How many events there are."""
    return events.agg(F.count("*").alias("events"))
