"""Sources of raw events: snapshots, COPY text, and files of change records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CHANGE, RAW

_COLUMNS = [c.split()[0] for c in RAW.split(", ")]


def snapshot(spark: SparkSession, path: str, kinds: frozenset[int] | None = None, after: int | None = None) -> DataFrame:
    """The stored rows, all of them inserts of lsn 0; empty if a checkpoint says that they were read before.

    The kinds are a predicate of the scan.
    """
    df = spark.read.schema(RAW).parquet(path)
    if kinds is not None:
        df = df.where(F.col("kind").isin(*sorted(kinds)))
    if after is not None:
        df = df.where(F.lit(False))
    return df.withColumns({"_diff": F.lit(1), "_lsn": F.lit(0).cast("bigint")})


def jdbc_snapshot(spark: SparkSession, url: str, relation: str, properties: dict[str, str], bounds: tuple[int, int], parts: int) -> DataFrame:
    """A table over JDBC, read in ranges of created_at by `parts` tasks."""
    return spark.read.jdbc(url, relation, column="created_at", lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, properties=properties)


def _unescape(c: Column) -> Column:
    """COPY's backslash escapes; any other escaped character stands for itself."""
    mark = "\x00"
    c = F.replace(c, F.lit("\\\\"), F.lit(mark))
    for letter, char in (("n", "\n"), ("r", "\r"), ("t", "\t"), ("b", "\b"), ("f", "\f")):
        c = F.replace(c, F.lit("\\" + letter), F.lit(char))
    c = F.regexp_replace(c, r"\\(.)", "$1")
    return F.replace(c, F.lit(mark), F.lit("\\"))


def copy_text(lines: DataFrame, column: str = "value") -> DataFrame:
    r"""Rows of COPY's text format: id, pubkey, created_at, kind, tags, content, sig, parted by tabs.

    \N is null: an empty list of tags, empty content; other nulls, too few or
    too many fields, and what isn't a number or hexadecimal drop the row.
    Binary columns are text in hexadecimal, with or without \x before.
    """
    f = F.split(F.col(column), "\t")
    at = lambda i: F.get(f, F.lit(i))
    some = lambda i, empty: F.when(at(i) == "\\N", F.lit(empty)).otherwise(_unescape(at(i)))
    binary = lambda i, n: F.try_to_binary(F.regexp_replace(at(i), r"^\\\\?x", ""), F.lit("hex"))
    out = lines.where(F.size(f) == 7).select(
        binary(0, 32).alias("id"), binary(1, 32).alias("pubkey"), at(2).try_cast("bigint").alias("created_at"), at(3).try_cast("int").alias("kind"),
        some(4, "[]").alias("tags"), some(5, "").alias("content"), binary(6, 64).alias("sig"),
    )
    return out.where((F.length("id") == 32) & (F.length("pubkey") == 32) & (F.length("sig") == 64) & F.col("created_at").isNotNull() & F.col("kind").isNotNull())


def decode_changes(changes: DataFrame) -> DataFrame:
    """Change records as signed rows: inserts 1, deletes with the whole old row -1; updates are ignored."""
    whole = F.lit(True)
    for c in ("id", "pubkey", "created_at", "kind", "sig"):
        whole &= F.col(c).isNotNull()
    return changes.where(F.col("op").isin("insert", "delete") & whole).select(
        *[F.coalesce(c, F.lit({"tags": "[]", "content": ""}[c])).alias(c) if c in ("tags", "content") else F.col(c) for c in _COLUMNS],
        F.when(F.col("op") == "insert", 1).otherwise(-1).alias("_diff"),
        F.col("lsn").alias("_lsn"),
    )


def change_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of change records from Parquet files, so many a batch."""
    raw = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return decode_changes(raw)
