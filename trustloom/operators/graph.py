"""Edges of events, PageRank and k-core."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FOLLOWS

START_RANK, RESET_RANK = 6_000_000, 1_000_000
#: Graphs of at most so many distinct edges are iterated in one task; larger ones by distributed joins.
SMALL = 2_000_000


def edges(events: DataFrame) -> DataFrame:
    """(kind, src, dst, label) of every tag that names a node; a bag."""
    tag = F.explode(F.filter("tags", lambda t: t["label"] != "Bolt11"))
    return events.select("kind", F.col("pubkey").alias("src"), tag.alias("t")).select("kind", "src", F.col("t.node").alias("dst"), F.col("t.label").alias("label"))


def tag_keys(events: DataFrame) -> DataFrame:
    """(label, node, id): the inverted index of tags."""
    tag = F.explode(F.filter("tags", lambda t: t["label"] != "Bolt11"))
    return events.select("id", tag.alias("t")).select(F.col("t.label").alias("label"), F.col("t.node").alias("node"), "id")


def p_tags(events: DataFrame) -> DataFrame:
    return tag_keys(events).where(F.col("label") == "Pubkey").select("id", F.col("node").alias("pubkey"))


def author_topics(events: DataFrame) -> DataFrame:
    tag = F.explode(F.filter("tags", lambda t: t["label"] == "Topic"))
    return events.select("pubkey", tag.alias("t")).select("pubkey", F.col("t.node").alias("topic"))


def follows(events: DataFrame) -> DataFrame:
    """(src, dst) of follow lists; repeated entries stay repeated."""
    return edges(events.where(F.col("kind") == FOLLOWS)).where(F.col("label") == "Pubkey").select("src", "dst")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder of spark.checkpoint.dir; only a single local process may go without one."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="trustloom-"))
    return df.checkpoint(eager=True)


def weighted(edges_: DataFrame) -> DataFrame:
    """(src, dst, m): distinct edges with the number of times they occur."""
    return edges_.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.count("*").alias("m"))


def _small_pagerank(iterations: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts or not sum(map(len, parts)):
            return
        e = pd.concat(parts)
        m = e["m"].to_numpy(np.int64)
        nodes, at = np.unique(np.concatenate([e["src"].to_numpy(np.int64), e["dst"].to_numpy(np.int64)]), return_inverse=True)
        src, dst = at[: len(e)], at[len(e) :]
        order = np.argsort(dst, kind="stable")
        src, dst, m = src[order], dst[order], m[order]
        first = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]]))
        degree = np.zeros(len(nodes), np.int64)
        np.add.at(degree, src, m)
        ranks = np.full(len(nodes), START_RANK, np.int64)
        done = 0
        while True:
            push = np.where(degree > 0, 5 * ranks // np.maximum(6 * degree, 1), 0)
            new = np.full(len(nodes), RESET_RANK, np.int64)
            new[dst[first]] += np.add.reduceat(push[src] * m, first)
            done += 1
            same = (new == ranks).all()
            ranks = new
            if done == iterations or not iterations and same:
                break
        yield pd.DataFrame({"node": nodes, "rank": ranks})

    return run


def pagerank(edges_: DataFrame, iterations: int, small: int = SMALL, every: int = 4) -> DataFrame:
    """(node, rank) after exactly so many integer steps; 0: until nothing changes.

    A step sends floor(5 rank / 6 degree) along every edge, parallel ones
    included, and gives each node RESET_RANK. What nodes without edges out
    hold is lost. Up to `small` distinct edges one task holds the whole graph;
    beyond, a step is a join on src and a sum by dst, cut off every few steps.
    """
    e = cut(weighted(edges_))
    if e.count() <= small:
        return e.coalesce(1).mapInPandas(_small_pagerank(iterations), "node bigint, rank bigint")
    degree = e.groupBy("src").agg(F.sum("m").alias("degree"))
    e = cut(e.join(degree, "src").select("src", "dst", "m", "degree"))
    nodes = cut(e.select(F.col("src").alias("node")).unionAll(e.select("dst")).distinct())
    base = nodes.select(F.col("node"), F.lit(RESET_RANK).cast("bigint").alias("rank"))
    ranks = nodes.select("node", F.lit(START_RANK).cast("bigint").alias("rank"))
    done = 0
    while True:
        sent = e.join(ranks, e["src"] == ranks["node"]).select(F.col("dst").alias("node"), (F.expr("(5 * rank) div (6 * degree)") * F.col("m")).alias("rank"))
        new = sent.unionAll(base).groupBy("node").agg(F.sum("rank").alias("rank"))
        done += 1
        if not iterations:
            new = cut(new)
            if new.exceptAll(ranks).isEmpty():
                return new
        elif done == iterations:
            return new
        elif done % every == 0:
            new = cut(new)
        ranks = new


def _small_k_core(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts or not sum(map(len, parts)):
            return
        e = pd.concat(parts)
        m = e["m"].to_numpy(np.int64)
        nodes, at = np.unique(np.concatenate([e["src"].to_numpy(np.int64), e["dst"].to_numpy(np.int64)]), return_inverse=True)
        src, dst = at[: len(e)], at[len(e) :]
        alive = np.ones(len(nodes), bool)
        while True:
            live = alive[src] & alive[dst]
            into = np.bincount(dst[live], weights=m[live], minlength=len(nodes))
            new = alive & (into >= k)
            if (new == alive).all():
                break
            alive = new
        yield pd.DataFrame({"node": nodes[alive]})

    return run


def k_core(edges_: DataFrame, k: int, small: int = SMALL) -> DataFrame:
    """(node): the largest set whose members each have k edges into them from the set."""
    e = cut(weighted(edges_))
    if e.count() <= small:
        return e.coalesce(1).mapInPandas(_small_k_core(k), "node bigint")
    alive = cut(e.select(F.col("src").alias("node")).unionAll(e.select("dst")).distinct())
    size = alive.count()
    while True:
        live = e.join(alive, e["src"] == alive["node"], "left_semi").join(alive, e["dst"] == alive["node"], "left_semi")
        alive = cut(live.groupBy(F.col("dst").alias("node")).agg(F.sum("m").alias("n")).where(F.col("n") >= k).select("node"))
        now = alive.count()
        if now == size:  # the set only shrinks
            return alive
        size = now
