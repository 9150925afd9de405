"""Per-event assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, tags
from ..schema import NOTE, REACTION, REPOST, ZAP

COUNTS = "comment_cnt quote_cnt repost_cnt reaction_cnt zap_cnt zap_amount".split()


def engagement(events: DataFrame) -> DataFrame:
    """(event, column, zap_amount): one row for each tag that engages with an event, in one scan."""
    t, kind = F.col("tags"), F.col("kind")

    def part(cond: Column, labels: tuple[str, ...], what: str) -> Column:
        hits = F.when(cond, tags.labelled(t, *labels)).otherwise(F.array().cast(t_type))
        return F.transform(hits, lambda x: F.struct(x["node"].alias("event"), F.lit(what).alias("what"), F.lit(0).cast("bigint").alias("amount")))

    t_type = events.schema["tags"].dataType
    target = tags.first_node(t, "Mention")
    zap = F.when(
        (kind == ZAP) & target.isNotNull(),
        F.array(F.struct(target.alias("event"), F.lit("zap_cnt").alias("what"), F.coalesce(tags.last_amount(t), F.lit(0)).cast("bigint").alias("amount"))),
    ).otherwise(F.array().cast("array<struct<event: bigint, what: string, amount: bigint>>"))
    all_ = F.concat(
        part(kind == NOTE, ("Reply", "RootReply"), "comment_cnt"),
        part(kind == NOTE, ("Quote",), "quote_cnt"),
        part(kind == REPOST, ("Mention",), "repost_cnt"),
        part(kind == REACTION, ("Mention",), "reaction_cnt"),
        zap,
    )
    return events.where(kind.isin(NOTE, REPOST, REACTION, ZAP)).select(F.inline(all_))


def event_assertions(events: DataFrame) -> DataFrame:
    """A row for each event that was engaged with: counts, paid amount and rank."""
    e = engagement(events)
    sums = [F.count(F.when(F.col("what") == c, 1)).alias(c) for c in COUNTS[:-1]]
    counts = e.groupBy("event").agg(*sums, scores.saturating_sum(F.col("amount")).alias("zap_amount"))
    return counts.withColumn("rank", scores.event_rank(*[F.col(c) for c in COUNTS]))
