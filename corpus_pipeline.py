"""A training corpus from documents: toxicity, duplicates, benchmark passages, token ids.

STAGES are applied in order; each result is written as Parquet and read again
as the documents of the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.llm import _common, bpe, decontaminate, exact_dedup, jaccard_join, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't hold toxic; those of a null text stay."""
    model = toxicity.fit(docs, _common.table(spark, sf_dir, "labels"))
    p = F.round(toxicity.score(docs["text"], model, spark), 6)
    return docs.where(F.coalesce(p, F.lit(0.0)) < 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that of the smallest doc_id."""
    return exact_dedup.exact_dedup(docs).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose texts are equal or connected by near copies, that of the smallest doc_id; one without doc_id stays."""
    drop = jaccard_join.jaccard_join(docs).where("doc_id <> class_id").select("doc_id")
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage, word for word or nearly."""
    leaks = decontaminate.decontaminate(docs, _common.table(spark, sf_dir, "benchmark"))
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return bpe.bpe_encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("bpe", encode),
]

#: The stages fit a model, break ties by learnt scores and emit token ids: not SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's folder is deleted when the next one has been written from it."""
    docs, before = _common.table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        where = _common.shared_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(where)
        docs = spark.read.parquet(where)
        if before:
            _common.remove(spark, before)
        before = where
    return docs
