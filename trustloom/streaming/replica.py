"""From raw events to views: a snapshot, then changes, with a stored dictionary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tags
from ..operators import emit, intern, query
from ..operators.graph import cut
from ..schema import CONSUMED
from .incremental import Maintained, Views

#: Of equal lsn, in a batch, by what a row says.
_PLACE = ["_lsn", "created_at", "id", "_diff"]


@dataclass
class Replica:
    """Raw rows (schema.RAW with _diff and _lsn) kept as numbered events, views and derived events under a folder.

    Beside what Maintained stores: dictionary/<batch>, the numbers of all byte
    strings so far; raw/<batch>, the batch with its numbers; lsn/<batch>, how far
    it came; cards/<batch>, derived events of what it changed. A batch that runs
    again starts from the last complete one and writes the same.
    """

    spark: SparkSession
    root: str
    views: Views
    kinds: frozenset[int] | None = CONSUMED

    def __post_init__(self):
        self.maintained = Maintained(self.spark, self.root, self.views)

    def _path(self, *parts: object) -> str:
        return self.maintained._path(*parts)

    def lsn(self) -> int | None:
        """The last change that is in a complete batch; None before the snapshot."""
        done = self.maintained._batches()
        return self.spark.read.parquet(*[self._path("lsn", b) for b in done]).agg(F.max("lsn")).first()[0] if done else None

    def snapshot(self, rows: DataFrame, lsn: int = 0) -> None:
        """Takes the stored rows as the first batch, as of lsn; does nothing where one is complete."""
        if not self.maintained._batches():
            self.apply(rows.withColumns({"_diff": F.lit(1), "_lsn": F.lit(lsn).cast("bigint")}), 0, lsn)

    def apply(self, rows: DataFrame, batch: int, lsn: int | None = None) -> None:
        """For foreachBatch. Rows up to the stored lsn came with the snapshot or an earlier run and are left out."""
        seen = self.lsn() if batch else None
        if seen is not None:
            rows = rows.where(F.col("_lsn") > seen)
        if self.kinds is not None:
            rows = rows.where(F.col("kind").isin(*sorted(self.kinds)))
        rows = rows.where((F.length("id") == 32) & (F.length("pubkey") == 32))
        placed = cut(intern.number(rows, _PLACE, "_seq"))
        parsed = placed.select("id", "pubkey", "kind", "created_at", tags.parse_tags(F.col("tags")).alias("tags"), "_lsn", "_seq", "_diff")
        numbered, dictionary = intern.intern_events(parsed, self.maintained._before(batch, "dictionary"))
        dictionary.write.mode("overwrite").parquet(self._path("dictionary", batch))
        named = placed.join(numbered.select("_lsn", "_seq", F.col("id").alias("sym")), ["_lsn", "_seq"])
        named.write.mode("overwrite").parquet(self._path("raw", batch))
        top = placed.agg(F.coalesce(F.max("_lsn"), F.lit(lsn if lsn is not None else seen)).cast("bigint").alias("lsn"))
        top.write.mode("overwrite").parquet(self._path("lsn", batch))
        # ids and tags must have the numbers that were stored
        stored = self.spark.read.parquet(self._path("dictionary", batch))
        again, _ = intern.intern_events(parsed, stored)
        self.maintained.apply(again, batch)

    def start(self, changes: DataFrame, checkpoint: str, once: bool = True):
        """Follows a stream of change rows; batch numbers go on after the snapshot's."""
        writer = changes.writeStream.foreachBatch(lambda df, b: self.apply(df, b + 1)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()

    def dictionary(self) -> DataFrame:
        return self.spark.read.parquet(self._path("dictionary", self.maintained._batches()[-1]))

    def named(self, view: str, column: str) -> DataFrame:
        """A view with a column of numbers in hexadecimal."""
        df = intern.resolve(self.maintained.view(view), self.dictionary(), column, "_n")
        return df.withColumn(column, F.lower(F.hex("_n"))).drop("_n")

    def events(self, f: query.Filter, order: str = "index") -> DataFrame:
        """The stored events of a filter of hexadecimal ids and texts, rebuilt as JSON."""
        coded = query.from_text(f, self.dictionary())
        state = self.maintained.state()
        found = query.run(state, coded, order) if coded is not None else state.where(F.lit(False))
        raw = self.spark.read.parquet(*[self._path("raw", b) for b in self.maintained._batches()]).where("_diff > 0")
        rows = raw.join(found.select(F.col("id").alias("sym")).distinct(), "sym").dropDuplicates(["sym"])
        return query.to_json(rows.select("id", "pubkey", "created_at", "kind", "tags", "content", "sig"))

    def cards(self, batch: int) -> DataFrame:
        """Derived events of the users and events that a batch changed: only what is there now, no retractions."""
        changed = [self.spark.read.parquet(self._path("log", name, batch)).where("_diff > 0").drop("_diff", "_ts") for name in ("users", "events")]
        users, events = (intern.resolve(df, self.dictionary(), c, "_n").withColumn(c, F.lower(F.hex("_n"))).drop("_n") for df, c in zip(changed, ("pubkey", "event")))
        return emit.user_cards(users).unionByName(emit.event_cards(events))
