"""The bounded sample of labelled rows that the classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, target: str, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, t, y): at most `most` rows, one for each of the labelled keys of docs of the smallest hash.

    Labels of keys that docs hasn't with a text, null keys, labels other than
    0 and 1, and null texts are left out before the sample is taken. A key
    labelled more than once counts with its largest label, a key of several
    rows with the text of the smallest hash. Which rows these are doesn't depend
    on row order.
    """
    y, k, t = F.col(f"`{target}`"), F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{text}`").alias("t")
    known = labels.where(F.col(f"`{key}`").isNotNull() & y.isin(0, 1)).groupBy(k).agg(F.max(y).cast("int").alias("y"))
    with_text = docs.where(F.col(f"`{text}`").isNotNull())
    some = known.join(with_text.select(k), "k", "left_semi").orderBy(F.xxhash64("k"), "k").limit(most)
    texts = with_text.select(k, t).join(F.broadcast(some), "k")  # `most` rows of two numbers at most
    # a key of many rows is combined in each task first
    return texts.groupBy("k", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t"))["t"].alias("t")).select("k", "t", "y")
