"""The change feed of a source tree, and incremental upkeep of the index."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..sources.files import Files
from ..sources.tree import snapshot

EVENTS = "path string, event string, seq long"


class TreeChanges(DataSource):
    """Streaming source ``tree_changes``: created, modified and deleted files since the last poll.

    Options: ``path``, the tree; ``state``, a folder outside of it (or hidden in it) for its snapshots.
    """

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return EVENTS

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options["path"], self.options["state"])


class _Reader(SimpleDataSourceStreamReader):
    """The offset names a snapshot, which lies in a file of its own, so a restarted query goes on where it was."""

    def __init__(self, root: str, state: str):
        self.root, self.state = root, state
        os.makedirs(state, exist_ok=True)

    def _load(self, name: str) -> dict[str, tuple]:
        if not name:
            return {}
        with open(os.path.join(self.state, name), encoding="utf-8") as file:
            return {p: tuple(v) for p, v in json.load(file).items()}

    @staticmethod
    def _events(before: dict, now: dict, seq: int) -> list[tuple]:
        events = [(p, "created" if p not in before else "modified") for p in now if before.get(p) != now[p]] + [(p, "deleted") for p in before if p not in now]
        return [(p, e, seq + k) for k, (p, e) in enumerate(sorted(events))]

    def initialOffset(self) -> dict:
        return {"seq": "0", "snapshot": ""}

    def read(self, start: dict) -> tuple:
        now, seq = snapshot(self.root), int(start["seq"])
        rows = self._events(self._load(start["snapshot"]), now, seq)
        if not rows:
            return iter(()), start
        name = f"{seq + len(rows):016d}-{uuid.uuid4().hex}.json"
        with open(os.path.join(self.state, f".{name}"), "w", encoding="utf-8") as file:
            json.dump(now, file)
        os.replace(os.path.join(self.state, f".{name}"), os.path.join(self.state, name))
        return iter(rows), {"seq": str(seq + len(rows)), "snapshot": name}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._events(self._load(start["snapshot"]), self._load(end["snapshot"]), int(start["seq"])))

    def commit(self, end: dict) -> None:
        """Snapshots before that of a finished batch are not read again."""
        for name in os.listdir(self.state):
            if name.endswith(".json") and not name.startswith(".") and name < end["snapshot"]:
                os.remove(os.path.join(self.state, name))


def last_changes(events: DataFrame) -> DataFrame:
    """Of each path the last event of a batch."""
    last = events.groupBy("path").agg(F.max(F.struct("seq", "event")).alias("last"))
    return last.select("path", F.col("last.event").alias("event"), F.col("last.seq").alias("seq"))


def apply_changes(current: DataFrame, events: DataFrame, content: DataFrame) -> DataFrame:
    """Files after a batch: deleted ones go, created and modified ones take their new ``content`` rows."""
    last = last_changes(events)
    kept = current.join(last.select("path"), "path", "left_anti")
    new = content.join(last.filter("event <> 'deleted'").select("path"), "path", "left_semi")
    return kept.unionByName(new.select(*current.columns))


def watch(spark: SparkSession, root: str, on_batch, checkpoint: str, seconds: int = 2, once: bool = False, state: str | None = None):
    """Call ``on_batch(changes, batch_id)`` with the last event of each path; a started query.

    ``state`` is a folder that the driver sees as a plain path; that of the checkpoint if none is given.
    """
    spark.dataSource.register(TreeChanges)
    state = state or os.path.join(checkpoint.removeprefix("file://"), "snapshots")
    stream = spark.readStream.format("tree_changes").option("path", root).option("state", state).load()
    writer = stream.writeStream.foreachBatch(lambda df, n: on_batch(last_changes(df), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


class LatestEvents:
    """The last event of each path over all batches of a stream, as a stored table that each batch replaces.

    A batch that comes again (after a restart) writes the same folder anew, from the batch before it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.files = spark, Files(spark, folder)

    def table(self, before: int | None = None) -> DataFrame:
        done = [int(n) for n in self.files.names("done") if before is None or int(n) < before]
        if not done:
            return self.spark.createDataFrame([], EVENTS)
        return self.spark.read.schema(EVENTS).parquet(f"{self.files.root}/batch-{max(done):012d}")

    def take(self, batch: DataFrame, n: int) -> None:
        rows = last_changes(self.table(before=n).unionByName(batch.select("path", "event", "seq")))
        rows.write.mode("overwrite").parquet(f"{self.files.root}/batch-{n:012d}")
        self.files.publish(f"done/{n:012d}", "", overwrite=True)
        for old in self.files.names("done")[:-2]:
            self.files.delete(f"done/{old}"), self.files.delete(f"batch-{old}")


def keep_latest(events: DataFrame, latest: LatestEvents, checkpoint: str, once: bool = True):
    """A started query that takes the batches of the stream ``events`` into ``latest``."""
    writer = events.writeStream.foreachBatch(latest.take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def first_observations_stream(observations: DataFrame, ts: str = "ts", keep: str = "30 days") -> DataFrame:
    """First row of each (query_hash, language); state is dropped ``keep`` behind the newest ``ts``."""
    return observations.withWatermark(ts, keep).dropDuplicatesWithinWatermark(["query_hash", "language"])


def counted_observations_stream(observations: DataFrame, threshold: int = 500) -> DataFrame:
    """(language, total, calibrate) per batch: running totals in state; ``calibrate`` once, as a total reaches ``threshold``."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def count(key, batches, state):
        before = state.get[0] if state.exists else 0
        total = before + sum(len(b) for b in batches)
        state.update((total,))
        yield pd.DataFrame({"language": [key[0]], "total": [total], "calibrate": [before < threshold <= total]})

    return observations.groupBy("language").applyInPandasWithState(count, "language string, total long, calibrate boolean", "total long", "update", GroupStateTimeout.NoTimeout)


def ordered_events(events: DataFrame) -> DataFrame:
    """Events of a stored log with the number of each within its path."""
    return events.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("seq")))
