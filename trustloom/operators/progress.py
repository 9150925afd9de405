"""Counts that a job reports while it runs, without a second pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df, and what gives its number of rows (key rows) once a job has read all of it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def changed(diff: DataFrame, name: str, key: str = "node") -> tuple[DataFrame, Observation]:
    """Signed rows, and what gives their number, of additions and of removals."""
    seen = Observation(name)
    return diff.observe(seen, F.count(key).alias("rows"), F.count(F.when(F.col("_diff") > 0, 1)).alias("added"), F.count(F.when(F.col("_diff") < 0, 1)).alias("removed")), seen
