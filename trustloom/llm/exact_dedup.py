"""Exact duplicates: skew-safe combining (operator 9).

Rows are combined three times, and each time rows are equal only if their
whole texts are: within a map task, by (digest, salt), and by digest among the
winners of the salts. The salt spreads the copies of a hot text over `salts`
reducers, so no reducer sees more than one winner a salt of any text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exact_dedup(docs: DataFrame, salts: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each text, that of the smallest key, with all columns of docs, and `copies`.

    copies counts the rows that had the text. Rows of a null text have no
    content to compare: all of them stay, with copies 1. Empty texts equal each
    other. A null key loses to any other; of rows that agree in key and text one
    stays, the smallest in its other columns. Other columns may have any name
    and must be orderable; a column named copies is replaced.
    """
    names = [c for c in docs.columns if c != "copies"]
    rest = [c for c in names if c not in (key, text)]
    row = F.struct(
        F.col(f"`{key}`").isNull().alias("k0"),
        F.col(f"`{key}`").alias("k1"),
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)],
    )
    packed = docs.select(F.col(f"`{text}`").alias("t"), row.alias("r"))
    salted = packed.where(F.col("t").isNotNull()).select(
        F.xxhash64("t").alias("d"), F.pmod(F.xxhash64("r.k1"), F.lit(salts)).alias("s"), "t", "r"
    )
    by_salt = salted.groupBy("d", "s", "t").agg(F.min("r").alias("r"), F.count("*").alias("n"))
    winners = by_salt.groupBy("d", "t").agg(F.min("r").alias("r"), F.sum("n").alias("n"))
    none = packed.where(F.col("t").isNull()).select("t", "r", F.lit(1).cast("bigint").alias("n"))
    back = {key: F.col("r.k1"), text: F.col("t")} | {c: F.col(f"r.c{i}") for i, c in enumerate(rest)}
    return winners.select("t", "r", "n").unionAll(none).select(*[back[c].alias(c) for c in names], F.col("n").alias("copies"))


SQL = """
SELECT doc_id, text, lang, source, n_chars, copies FROM (
  SELECT *, count(*) OVER (PARTITION BY text) AS copies, row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST, lang NULLS FIRST, source NULLS FIRST, n_chars NULLS FIRST) AS k
  FROM documents WHERE text IS NOT NULL) WHERE k = 1
UNION ALL SELECT doc_id, text, lang, source, n_chars, 1 FROM documents WHERE text IS NULL
"""
