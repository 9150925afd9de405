"""A dictionary of byte strings: dense numbers from 1 in order of first appearance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

DICTIONARY = "bytes binary, sym bigint"


def number(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Dense numbers after start in the order of columns, without one task sorting all rows.

    Rows are range-partitioned and cut off, as ranges sampled anew would differ;
    each partition counts, the counts are summed before it, and rows are
    numbered within their partition.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    local = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    counts = ranged.groupBy("_p").count()  # a row a partition
    before = counts.withColumn("_b", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(before.select("_p", "_b")), "_p").withColumn(name, (F.col("_i") + F.col("_b") + start).cast("bigint")).drop("_p", "_i", "_b")


def extend(dictionary: DataFrame | None, seen: DataFrame, order: list[str]) -> DataFrame:
    """The dictionary with the byte strings of seen (column bytes) that it lacks; known ones keep their number."""
    first = seen.where("bytes is not null").groupBy("bytes").agg(F.min(F.struct(*order)).alias("_first"))
    start = 0
    if dictionary is not None:
        first = first.join(dictionary, "bytes", "left_anti")
        start = dictionary.agg(F.max("sym")).first()[0] or 0
    fresh = number(first, ["_first", "bytes"], "sym", start).select("bytes", "sym")
    return fresh if dictionary is None else dictionary.select("bytes", "sym").unionAll(fresh)


def intern(df: DataFrame, dictionary: DataFrame, column: str, name: str) -> DataFrame:
    d = dictionary.select(F.col("bytes").alias("_b"), F.col("sym").alias(name))
    return df.join(d, df[column] == d["_b"], "left").drop("_b")


def resolve(df: DataFrame, dictionary: DataFrame, column: str, name: str) -> DataFrame:
    d = dictionary.select(F.col("sym").alias("_s"), F.col("bytes").alias(name))
    return df.join(d, df[column] == d["_s"], "left").drop("_s")


def intern_events(raw: DataFrame, dictionary: DataFrame | None = None, order: tuple[str, ...] = ("_lsn", "_seq")) -> tuple[DataFrame, DataFrame]:
    """(events, dictionary) of raw events whose tags are parsed: ids, authors and tag values become numbers.

    Of one event the id comes first, then its author, then tags in order; of
    an address tag the owner before the address.
    """
    tag = F.posexplode("tags")
    place = [F.col(c) for c in order]
    flat = raw.select(*place, tag.alias("_at", "t"))
    seen = (
        raw.select(*place, F.lit(-2).alias("_at"), F.lit(0).alias("_part"), F.col("id").alias("bytes"))
        .unionAll(raw.select(*place, F.lit(-1).alias("_at"), F.lit(0).alias("_part"), F.col("pubkey").alias("bytes")))
        .unionAll(flat.select(*order, "_at", F.lit(0).alias("_part"), F.col("t.value").alias("bytes")))
        .unionAll(flat.select(*order, "_at", F.lit(1).alias("_part"), F.col("t.address").alias("bytes")))
    )
    dictionary = extend(dictionary, seen, [*order, "_at", "_part"])
    nodes = intern(intern(flat.select(*order, "_at", "t.label", "t.amount", F.col("t.value").alias("_v"), F.col("t.address").alias("_a")), dictionary, "_v", "node"), dictionary, "_a", "address")
    lists = nodes.groupBy(*order).agg(F.array_sort(F.collect_list(F.struct("_at", "label", "node", "address", "amount"))).alias("_l"))
    tags = F.coalesce(F.transform("_l", lambda x: F.struct(x["label"].alias("label"), x["node"].alias("node"), x["address"].alias("address"), x["amount"].alias("amount"))), F.array())
    named = intern(intern(raw.drop("tags").withColumnsRenamed({"id": "_id", "pubkey": "_author"}), dictionary, "_id", "id"), dictionary, "_author", "pubkey")
    return named.join(lists, list(order), "left").withColumn("tags", tags).drop("_l", "_id", "_author"), dictionary
