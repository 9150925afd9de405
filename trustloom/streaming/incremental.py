"""Incremental maintenance: change files in, current state and signed view changes out.

A micro-batch is what a closed frontier is to a dataflow system. Each batch
folds its changes into the state, derives the views, and writes how they
differ from the last ones. Every version is a folder named by its batch, and
the last complete one is what the next batch starts from, so a batch that is
run again after a failure writes the same.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import event_metrics, graph, store, user_metrics
from ..operators.relational import changes
from ..schema import EVENT, FOLLOWS
from ..sources.changes import change_stream

STATE = f"{EVENT}, _lsn bigint, _seq bigint"


@dataclass
class Views:
    """Views over current events, by name."""

    iterations: int = 30

    def build(self, events: DataFrame) -> dict[str, DataFrame]:
        follows = graph.follows(events)
        ranks = graph.cut(graph.pagerank(follows, self.iterations))
        rest = events.where(F.col("kind") != FOLLOWS)
        return {"users": user_metrics.user_assertions(rest, follows, ranks), "events": event_metrics.event_assertions(events), "ranks": ranks}


@dataclass
class Maintained:
    """State and views under a folder that all executors see.

    state/<batch>: every stored event, with the place at which it came in.
    views/<name>/<batch>: the view. log/<name>/<batch>: signed changes.
    """

    spark: SparkSession
    root: str
    views: Views

    def _path(self, *parts: object) -> str:
        return "/".join([self.root.rstrip("/"), *map(str, parts)])

    def _batches(self) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self._path("state"))
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return []
        done = [s.getPath() for s in fs.listStatus(hadoop)]
        return sorted(int(p.getName()) for p in done if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS")))

    def _before(self, batch: int, *what: str) -> DataFrame | None:
        older = [b for b in self._batches() if b < batch]
        return self.spark.read.parquet(self._path(*what, older[-1])) if older else None

    def apply(self, batch_df: DataFrame, batch: int) -> None:
        """For foreachBatch. batch_df: events with _diff, _lsn, _seq.

        Only the slots and ids that the batch touches are folded; the others
        pass through by an anti-join.
        """
        old = self._before(batch, "state")
        rows = batch_df.select("id", "pubkey", "kind", "created_at", "tags", "_lsn", "_seq", "_diff")
        if old is None:
            new = store.fold(rows, "_lsn", "_seq")
        else:
            touched = rows.select(F.coalesce(store.slot(rows), F.concat(F.lit("id:"), F.col("id").cast("string"))).alias("_slot")).distinct()
            keyed = old.withColumn("_slot", F.coalesce(store.slot(old), F.concat(F.lit("id:"), F.col("id").cast("string"))))
            again = keyed.join(touched, "_slot", "left_semi").drop("_slot").withColumn("_diff", F.lit(1))
            new = keyed.join(touched, "_slot", "left_anti").drop("_slot").unionByName(store.fold(again.unionByName(rows), "_lsn", "_seq"))
        views = self._derive(new, batch)
        for name, view in views.items():
            before = self._before(batch, "views", name)
            diff = changes(before, view) if before is not None else view.withColumn("_diff", F.lit(1).cast("bigint"))
            diff.withColumn("_ts", F.lit(batch)).write.mode("overwrite").parquet(self._path("log", name, batch))
        # last: that it is there makes the batch complete
        self.spark.read.parquet(self._path("pending", batch)).write.mode("overwrite").parquet(self._path("state", batch))

    def _derive(self, new: DataFrame, batch: int) -> dict[str, DataFrame]:
        new.write.mode("overwrite").parquet(self._path("pending", batch))
        state = self.spark.read.parquet(self._path("pending", batch))
        out = {}
        for name, view in self.views.build(state).items():
            view.write.mode("overwrite").parquet(self._path("views", name, batch))
            out[name] = self.spark.read.parquet(self._path("views", name, batch))
        return out

    def state(self) -> DataFrame:
        done = self._batches()
        return self.spark.read.parquet(self._path("state", done[-1])) if done else self.spark.createDataFrame([], STATE)

    def view(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path("views", name, self._batches()[-1]))

    def log(self, name: str) -> DataFrame:
        """All signed changes of a view, with the batch as _ts."""
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(self._path("log", name, b)) for b in self._batches()])

    def start(self, events: DataFrame, checkpoint: str, once: bool = True):
        """Maintain the state from a stream of signed event rows (column _diff, _lsn, _seq)."""
        writer = events.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of numbered event rows with _diff, _lsn, _seq from Parquet files."""
    return spark.readStream.schema(f"{STATE}, _diff int").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


__all__ = ["Maintained", "Views", "change_stream", "event_stream"]
