"""Integer scores from ranks and engagement, and time buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Followers of a lower normalised rank don't count.
FOLLOWER_RANK = 8
#: A saturating sum stops here, the largest number of a bigint.
MOST = (1 << 63) - 1


def _clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def normalize_rank(rank: Column) -> Column:
    """0 to 100 from a PageRank; 0 for ranks that aren't positive, null for null."""
    share = F.lit(0.24) / (rank / F.lit(6e6) + F.lit(0.24))
    score = F.round(_clamp(F.lit(100.0) * (F.lit(1.0) - F.pow(share, F.lit(0.38))))).cast("bigint")
    return F.when(rank <= 0, F.lit(0).cast("bigint")).otherwise(score)


def event_rank(comments: Column, quotes: Column, reposts: Column, reactions: Column, zaps: Column, amount: Column) -> Column:
    """0 to 100 from an event's engagement."""
    paid = (zaps > 0) & (amount > 0)
    tips = F.when(paid, 5 * zaps + 2 * F.log10(F.when(paid, amount).cast("double"))).otherwise(F.lit(0.0))
    s = 3 * comments + 4 * quotes + 2 * reposts + reactions + tips
    return F.when(s > 0, F.round(F.least(F.lit(100.0), 20 * F.log10(F.when(s > 0, s + 1.0)))).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def day(seconds: Column) -> Column:
    return F.floor(seconds / 86400).cast("bigint")


def hour(seconds: Column) -> Column:
    """Hour of the day in UTC."""
    return F.pmod(F.floor(seconds / 3600).cast("bigint"), F.lit(24)).cast("int")


def saturating_sum(x: Column) -> Column:
    """Sum of bigints that stops at MOST instead of overflowing; null of nothing."""
    total = F.sum(x.cast("decimal(20,0)"))
    return F.when(total > F.lit(MOST).cast("decimal(38,0)"), F.lit(MOST)).otherwise(total.cast("bigint"))


def hex_id(b: Column) -> Column:
    return F.lower(F.hex(b))
