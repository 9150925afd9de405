"""Whole views over events, from follow graph to ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import event_metrics, graph, user_metrics
from ..operators.relational import as_list, positions, top_k
from ..schema import FOLLOWS, PAGERANK_ITERATIONS, TOP


def trust_top(events: DataFrame, k: int = 10, iterations: int = 20) -> DataFrame:
    """(position, pubkey, rank): the k users of the highest normalised PageRank."""
    ranks = user_metrics.normalized_ranks(graph.pagerank(graph.follows(events), iterations))
    return positions(top_k(ranks, "rank", "pubkey", k), "rank", "pubkey")


def users(events: DataFrame, iterations: int = PAGERANK_ITERATIONS) -> DataFrame:
    """User assertions; follow lists count as edges, not as events."""
    follows = graph.follows(events)
    return user_metrics.user_assertions(events.where(F.col("kind") != FOLLOWS), follows, graph.pagerank(follows, iterations))


def top_ranks(events: DataFrame, iterations: int = PAGERANK_ITERATIONS, k: int = TOP) -> DataFrame:
    """ranked(users, "rank") without the other metrics."""
    return ranked(user_metrics.normalized_ranks(graph.pagerank(graph.follows(events), iterations)).where("pubkey is not null"), "rank", k)


def top_followers(events: DataFrame, iterations: int = PAGERANK_ITERATIONS, k: int = TOP) -> DataFrame:
    """ranked(users, "follower_cnt") without the other metrics: those of no follower count with 0."""
    follows = graph.follows(events)
    ranks = user_metrics.normalized_ranks(graph.pagerank(follows, iterations))
    zero = F.lit(0).cast("bigint").alias("follower_cnt")
    known = ranks.select("pubkey", zero).unionAll(user_metrics.known_users(events.where(F.col("kind") != FOLLOWS)).select("pubkey", zero))
    counts = known.unionByName(user_metrics.follower_counts(follows, ranks)).where("pubkey is not null").groupBy("pubkey").agg(F.sum("follower_cnt").alias("follower_cnt"))
    return ranked(counts, "follower_cnt", k)


def engaged_events(events: DataFrame) -> DataFrame:
    return event_metrics.event_assertions(events)


def ranked(assertions: DataFrame, metric: str, k: int = TOP) -> DataFrame:
    """(position, pubkey, metric) of the k largest; null metrics are left out."""
    return positions(top_k(assertions.where(F.col(metric).isNotNull()), metric, "pubkey", k), metric, "pubkey")


def ranked_list(assertions: DataFrame, metric: str, k: int = TOP) -> DataFrame:
    """One row with the list; none without entries."""
    return as_list(top_k(assertions.where(F.col(metric).isNotNull()), metric, "pubkey", k), metric, "pubkey")
