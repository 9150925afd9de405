"""The driver's tables as events and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FOLLOWS, NOTE, REACTION, REPORT, TAG, ZAP


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as social events: signups follow, views are notes, clicks react, errors report, purchases pay."""
    none = F.lit(None).cast("bigint")

    def tag(label, node=none, amount=none):
        return F.struct(F.lit(label).alias("label") if isinstance(label, str) else label.alias("label"), node.cast("bigint").alias("node"), none.alias("address"), amount.cast("bigint").alias("amount"))

    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = (
        F.when(F.col("event_type") == "signup", FOLLOWS)
        .when(F.col("event_type") == "view", NOTE)
        .when(F.col("event_type") == "click", REACTION)
        .when(F.col("event_type") == "error", REPORT)
        .otherwise(ZAP)
    )
    turn = F.col("event_id") % 3
    tags = (
        F.when(kind.isin(FOLLOWS, REPORT), F.array(tag("Pubkey", k)))
        .when(kind == REACTION, F.array(tag("Mention", k)))
        .when((kind == NOTE) & (turn < 2), F.array(tag(F.when(turn == 0, "Reply").otherwise("RootReply"), k)))
        .when(kind == ZAP, F.array(tag("Mention", k), tag("Pubkey", k), tag("PubkeyUpper", F.col("user_id")), tag("Bolt11", amount=F.floor("value"))))
        .otherwise(F.array().cast(f"array<{TAG}>"))
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("pubkey"),
        kind.cast("int").alias("kind"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("created_at"),
        tags.cast(f"array<{TAG}>").alias("tags"),
    )


def purchases_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from customers to the suppliers of their orders; supplier numbers are negative."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).select(F.col("o_custkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst"))
