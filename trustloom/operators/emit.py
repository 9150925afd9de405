"""Metrics as unsigned event rows (kind, content, tags as JSON)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EVENT_CARD, RANKED_LIST, USER_CARD

_USER = (
    "follower_cnt post_cnt reply_cnt reactions_cnt zap_amt_recd zap_amt_sent zap_cnt_recd zap_cnt_sent reports_cnt_sent reports_cnt_recd".split(),
    "rank first_created_at active_hours_start active_hours_end".split(),
)
_EVENT = "rank comment_cnt quote_cnt repost_cnt reaction_cnt zap_cnt zap_amount".split()


def _pair(name: str, value: Column) -> Column:
    return F.array(F.lit(name), value.cast("string"))


def _row(kind: int, tags: Column) -> list[Column]:
    return [F.lit(kind).alias("kind"), F.lit("").alias("content"), F.to_json(tags).alias("tags")]


def user_cards(assertions: DataFrame, identifier: str = "pubkey") -> DataFrame:
    """Daily means aren't emitted; null metrics have no tag."""
    must, may = _USER
    optional = F.filter(F.array(*[F.when(F.col(c).isNotNull(), _pair(c, F.col(c))) for c in may]), lambda t: t.isNotNull())
    tags = F.concat(F.array(_pair("d", F.col(identifier)), *[_pair(c, F.col(c)) for c in must]), optional)
    return assertions.select(*_row(USER_CARD, tags))


def event_cards(assertions: DataFrame, identifier: str = "event") -> DataFrame:
    tags = F.array(_pair("d", F.col(identifier)), _pair("e", F.col(identifier)), *[_pair(c, F.col(c)) for c in _EVENT])
    return assertions.select(*_row(EVENT_CARD, tags))


def list_event(entries: DataFrame, name: str, title: str, metric: str) -> DataFrame:
    """A ranked list (column entries of score, pubkey); entries of a null pubkey are skipped."""
    some = F.filter("entries", lambda e: e["pubkey"].isNotNull())
    people = F.transform(some, lambda e: F.array(F.lit("p"), e["pubkey"].cast("string"), F.lit(""), e["score"].cast("string")))
    head = F.array(_pair("d", F.lit(name)), _pair("title", F.lit(title)), _pair("metric", F.lit(metric)))
    return entries.select(*_row(RANKED_LIST, F.concat(head, people)))


def rank_list(entries: DataFrame) -> DataFrame:
    return list_event(entries, "ranks", "Top Pubkeys by Rank", "rank")


def follower_list(entries: DataFrame) -> DataFrame:
    return list_event(entries, "followers", "Top Pubkeys by Followers", "follower_cnt")


def payloads(users: DataFrame, events: DataFrame, ranks: DataFrame, followers: DataFrame) -> DataFrame:
    """All derived events, with what they are in payload_type."""
    parts = (("user", user_cards(users)), ("event", event_cards(events)), ("ranks", rank_list(ranks)), ("followers", follower_list(followers)))
    out = None
    for name, df in parts:
        df = df.withColumn("payload_type", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out
