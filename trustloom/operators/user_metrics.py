"""Per-user assertions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, tags
from ..schema import REACTION, REPORT, ZAP

COUNTS = (
    "follower_cnt post_cnt reply_cnt reactions_cnt zap_amt_recd zap_amt_sent zap_cnt_recd zap_cnt_sent "
    "zap_avg_amt_day_recd zap_avg_amt_day_sent reports_cnt_recd reports_cnt_sent"
).split()
OPTIONAL = "rank first_created_at active_hours_start active_hours_end".split()


def normalized_ranks(ranks: DataFrame) -> DataFrame:
    return ranks.select(F.col("node").alias("pubkey"), scores.normalize_rank(F.col("rank")).alias("rank"))


def follower_counts(follows: DataFrame, normalized: DataFrame) -> DataFrame:
    """Distinct followers whose own rank is high enough."""
    good = normalized.where(F.col("rank") >= scores.FOLLOWER_RANK).select(F.col("pubkey").alias("src"))
    return follows.distinct().join(good, "src", "left_semi").groupBy(F.col("dst").alias("pubkey")).agg(F.count("*").alias("follower_cnt"))


def authored(events: DataFrame) -> DataFrame:
    """What is counted by author, in one aggregation."""
    kind, t = F.col("kind"), F.col("tags")
    n = lambda cond: F.count(F.when(cond, 1))
    hour = scores.hour(F.col("created_at"))
    return events.groupBy("pubkey").agg(
        F.min("created_at").alias("first_created_at"),
        n(tags.is_root_post(kind, t)).alias("post_cnt"),
        n(tags.is_reply(kind, t)).alias("reply_cnt"),
        n(kind == REACTION).alias("reactions_cnt"),
        n(kind == REPORT).alias("reports_cnt_sent"),
        F.min(hour).cast("bigint").alias("active_hours_start"),
        F.max(hour).cast("bigint").alias("active_hours_end"),
    )


def reports_received(events: DataFrame) -> DataFrame:
    target = F.explode(tags.labelled(F.col("tags"), "Pubkey"))
    return events.where(F.col("kind") == REPORT).select(target.alias("t")).groupBy(F.col("t.node").alias("pubkey")).agg(F.count("*").alias("reports_cnt_recd"))


def zaps(events: DataFrame) -> DataFrame:
    """(sender, recipient, amount, day): payments that name an amount; either side may be null."""
    t = F.col("tags")
    return events.where(F.col("kind") == ZAP).select(
        tags.first_node(t, "PubkeyUpper").alias("sender"), tags.first_node(t, "Pubkey").alias("recipient"), tags.last_amount(t).alias("amount"), scores.day(F.col("created_at")).alias("day")
    ).where(F.col("amount").isNotNull())


def _whole(total: Column, n: Column) -> Column:
    """total / n in whole numbers, null for no n."""
    return F.call_function("div", total, F.nullif(n, F.lit(0).cast("bigint")))


def zaps_sent(zaps_: DataFrame) -> DataFrame:
    """Sums over all days with a payment, also those of nothing."""
    daily = zaps_.where(F.col("sender").isNotNull()).groupBy(F.col("sender").alias("pubkey"), "day").agg(scores.saturating_sum(F.col("amount")).alias("a"), F.count("*").alias("n"))
    total = scores.saturating_sum(F.col("a"))
    return daily.groupBy("pubkey").agg(total.alias("zap_amt_sent"), F.sum("n").alias("zap_cnt_sent"), _whole(total, F.count("*")).alias("zap_avg_amt_day_sent"))


def zaps_received(zaps_: DataFrame) -> DataFrame:
    """As zaps_sent, but days of nothing don't count for the mean."""
    daily = zaps_.where(F.col("recipient").isNotNull()).groupBy(F.col("recipient").alias("pubkey"), "day").agg(scores.saturating_sum(F.col("amount")).alias("a"), F.count("*").alias("n"))
    total = scores.saturating_sum(F.col("a"))
    return daily.groupBy("pubkey").agg(
        total.alias("zap_amt_recd"), F.sum("n").alias("zap_cnt_recd"), F.coalesce(_whole(total, F.count(F.nullif(F.col("a"), F.lit(0).cast("bigint")))), F.lit(0).cast("bigint")).alias("zap_avg_amt_day_recd")
    )


_ACTIVITY = (
    "pubkey bigint, created_at bigint, post int, reply int, reaction int, sent_report int, hour int, report int, "
    "paid bigint, paid_day bigint, got bigint, got_day bigint"
)


def activity(events: DataFrame) -> DataFrame:
    """authored, reports_received, zaps_sent and zaps_received in one scan and one shuffle.

    An event gives a sparse row to each user it says something of. Days are
    gathered as sets, which the calendar bounds.
    """
    kind, t = F.col("kind"), F.col("tags")
    fields = [f.split() for f in _ACTIVITY.split(", ")]
    row = lambda **have: F.struct(*[have.get(n, F.lit(None)).cast(k).alias(n) for n, k in fields])
    day, amount = scores.day(F.col("created_at")), tags.last_amount(t)
    own = row(
        pubkey=F.col("pubkey"), created_at=F.col("created_at"), post=tags.is_root_post(kind, t), reply=tags.is_reply(kind, t), reaction=kind == REACTION,
        sent_report=kind == REPORT, hour=scores.hour(F.col("created_at")),
    )
    none = F.array().cast(f"array<struct<{_ACTIVITY.replace(' ', ':').replace(',:', ',')}>>")
    reports = F.when(kind == REPORT, F.transform(tags.labelled(t, "Pubkey"), lambda x: row(pubkey=x["node"], report=F.lit(1)))).otherwise(none)
    paid = F.when(
        (kind == ZAP) & amount.isNotNull(),
        F.array(row(pubkey=tags.first_node(t, "PubkeyUpper"), paid=amount, paid_day=day), row(pubkey=tags.first_node(t, "Pubkey"), got=amount, got_day=day)),
    ).otherwise(none)
    rows = events.select(F.inline(F.concat(F.array(own), reports, paid))).where("pubkey is not null")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    sent, recd = scores.saturating_sum(F.col("paid")), scores.saturating_sum(F.col("got"))
    zero = F.lit(0).cast("bigint")
    return rows.groupBy("pubkey").agg(
        F.min("created_at").alias("first_created_at"), n("post").alias("post_cnt"), n("reply").alias("reply_cnt"), n("reaction").alias("reactions_cnt"),
        n("sent_report").alias("reports_cnt_sent"), F.min("hour").cast("bigint").alias("active_hours_start"), F.max("hour").cast("bigint").alias("active_hours_end"),
        n("report").alias("reports_cnt_recd"),
        F.coalesce(sent, zero).alias("zap_amt_sent"), F.count("paid").alias("zap_cnt_sent"), F.coalesce(_whole(sent, F.size(F.collect_set("paid_day")).cast("bigint")), zero).alias("zap_avg_amt_day_sent"),
        F.coalesce(recd, zero).alias("zap_amt_recd"), F.count("got").alias("zap_cnt_recd"),
        F.coalesce(_whole(recd, F.size(F.collect_set(F.when(F.col("got") != 0, F.col("got_day")))).cast("bigint")), zero).alias("zap_avg_amt_day_recd"),
    )


def known_users(events: DataFrame) -> DataFrame:
    """Everyone that activity() has a row for."""
    kind, t = F.col("kind"), F.col("tags")
    who = F.concat(
        F.array("pubkey"),
        F.when(kind == REPORT, F.transform(tags.labelled(t, "Pubkey"), lambda x: x["node"])).otherwise(F.array().cast("array<bigint>")),
        F.when((kind == ZAP) & tags.last_amount(t).isNotNull(), F.array(tags.first_node(t, "PubkeyUpper"), tags.first_node(t, "Pubkey"))).otherwise(F.array().cast("array<bigint>")),
    )
    return events.select(F.explode(who).alias("pubkey")).where("pubkey is not null").distinct()


def user_assertions(events: DataFrame, follows: DataFrame, ranks: DataFrame) -> DataFrame:
    """A row for each user that any metric knows: counts default to 0, OPTIONAL to null.

    The parts are sparse rows that one aggregation folds together; events are
    scanned once.
    """
    normalized = normalized_ranks(ranks)
    parts = [normalized, follower_counts(follows, normalized), activity(events)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    folded = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTS] + [F.max(c).alias(c) for c in OPTIONAL]
    return rows.where(F.col("pubkey").isNotNull()).groupBy("pubkey").agg(*folded)
