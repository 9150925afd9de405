"""Signed multisets, and top-k over weighted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIFF = "_diff"


def consolidate(df: DataFrame) -> DataFrame:
    """Equal rows as one with the sum of their signs; rows that cancel go."""
    keys = [c for c in df.columns if c != DIFF]
    return df.groupBy(*keys).agg(F.sum(DIFF).cast("bigint").alias(DIFF)).where(F.col(DIFF) != 0)


def threshold(df: DataFrame) -> DataFrame:
    """Distinct rows of positive weight, each of weight 1."""
    return consolidate(df).where(F.col(DIFF) > 0).withColumn(DIFF, F.lit(1).cast("bigint"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """What turns old into new, as signed rows; copies count."""
    cols = old.columns
    both = old.withColumn(DIFF, F.lit(-1)).unionByName(new.select(*cols).withColumn(DIFF, F.lit(1)))
    return consolidate(both)


def apply_changes(old: DataFrame, diff: DataFrame) -> DataFrame:
    """old with signed rows added; rows of weight n stand n times."""
    all_ = consolidate(old.withColumn(DIFF, F.lit(1)).unionByName(diff)).where(F.col(DIFF) > 0)
    return all_.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(DIFF)))).drop("_i", DIFF)


def top_k(df: DataFrame, score: str, key: str, k: int, weight: str | None = None) -> DataFrame:
    """The k largest (score, key) in descending order; of equal scores the larger key first.

    Without weights this is one bounded heap a task. A row of weight w fills up
    to w places, one of a weight that isn't positive none; as no more than k
    rows can fill k places, the weights are spread after a first cut.
    """
    order = [F.desc(score), F.desc(key)]
    if weight is None:
        return df.select(key, score).orderBy(*order).limit(k)
    some = df.where(F.col(weight) > 0).groupBy(score, key).agg(F.sum(weight).alias("w")).orderBy(*order).limit(k)
    return some.withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least("w", F.lit(k).cast("bigint"))))).orderBy(*order).limit(k).select(key, score)


def positions(top: DataFrame, score: str, key: str) -> DataFrame:
    """A bounded top list with its places from 1."""
    w = Window.orderBy(F.desc(score), F.desc(key))
    return top.withColumn("position", F.row_number().over(w).cast("bigint")).select("position", key, score)


def as_list(top: DataFrame, score: str, key: str) -> DataFrame:
    """One row with the list in descending order; none for an empty list."""
    packed = F.sort_array(F.collect_list(F.struct(F.col(score).alias("score"), F.col(key).alias("pubkey"))), asc=False)
    return top.agg(packed.alias("entries")).where(F.size("entries") > 0)
