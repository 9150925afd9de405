"""An engine over a stored event table, and its command line."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import emit, query
from ..operators.relational import as_list, top_k
from ..schema import CONSUMED, PAGERANK_ITERATIONS, TOP
from . import reputation


@dataclass
class Engine:
    """Events with numbered nodes (schema.EVENT), and the dictionary that numbers them."""

    events: DataFrame
    dictionary: DataFrame | None = None
    iterations: int = PAGERANK_ITERATIONS
    top: int = TOP

    def consumed(self) -> DataFrame:
        return self.events.where(F.col("kind").isin(*sorted(CONSUMED)))

    def query(self, f: query.Filter, order: str = "index") -> DataFrame:
        """Events of a filter. With a dictionary its values are hexadecimal and texts."""
        if self.dictionary is not None:
            f = query.from_text(f, self.dictionary)
            if f is None:
                return self.events.where(F.lit(False))
        return query.run(self.events, f, order)

    def users(self) -> DataFrame:
        return reputation.users(self.consumed(), self.iterations)

    def cards(self) -> DataFrame:
        """All derived events, unsigned; merging them back into the store is up to the caller."""
        users = self.users()
        lists = [as_list(top_k(users.where(F.col(m).isNotNull()), m, "pubkey", self.top), m, "pubkey") for m in ("rank", "follower_cnt")]
        return emit.payloads(users, reputation.engaged_events(self.consumed()), *lists)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Reputation views over a table of events")
    p.add_argument("events", help="Parquet of numbered events")
    p.add_argument("output", help="folder for users, events, lists")
    p.add_argument("--iterations", type=int, default=PAGERANK_ITERATIONS)
    p.add_argument("--top", type=int, default=TOP)
    p.add_argument("--cards", action="store_true", help="write derived events too")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("trustloom").getOrCreate()
    e = Engine(spark.read.parquet(a.events), iterations=a.iterations, top=a.top)
    e.users().write.parquet(f"{a.output}/users")
    users = spark.read.parquet(f"{a.output}/users")
    reputation.engaged_events(e.consumed()).write.parquet(f"{a.output}/events")
    for metric in ("rank", "follower_cnt"):
        reputation.ranked(users, metric, a.top).write.parquet(f"{a.output}/top_{metric}")
    if a.cards:
        e.cards().write.parquet(f"{a.output}/cards")


if __name__ == "__main__":
    main()
