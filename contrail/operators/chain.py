"""Appending to hash chains (E10): an event is written only behind the event that it names."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .audit import ZERO

#: The states of a chronology, in the only legal order.
CHRONOLOGY = ("PROTOCOL_FROZEN", "DATASET_GENERATED", "DATASET_VALIDATED", "SPLIT_SEALED", "DEVELOPMENT_COMPLETE", "PRE_TEST_FROZEN", "TEST_ACCESSED", "FORMAL_EVALUATION_COMPLETE")
EVENT = "log_id string, event_index int, event_type string, previous_event_hash string, event_hash string"


def tails(log: DataFrame) -> DataFrame:
    """(log_id, event_index, event_hash) of the last event of each log."""
    last = F.max_by(F.struct("event_index", "event_hash"), "event_index")
    return log.groupBy("log_id").agg(last.alias("t")).select("log_id", "t.*")


def decided(tail: DataFrame, proposed: DataFrame, digest: Column, order: Sequence[str] | None = CHRONOLOGY) -> DataFrame:
    """proposed with code: ACCEPTED, or why not.

    STALE: the log's last event is not the one named, or the index is not the next; STATE: not the state whose turn it is;
    DIGEST: the event's hash is not its own; LOST: another event of the same table took the index, the one with the
    smallest hash.
    """
    at = tail.select(F.col("log_id").alias("_log"), F.col("event_index").alias("_last"), F.col("event_hash").alias("_hash"))
    rows = proposed.withColumn("_own", digest).join(at, F.col("log_id") == F.col("_log"), "left")
    rows = rows.withColumns({"_next": F.coalesce(F.col("_last") + 1, F.lit(0)), "_before": F.coalesce("_hash", F.lit(ZERO))})
    turn = F.element_at(F.array(*[F.lit(s) for s in order or ()], F.lit(None).cast("string")), F.least(F.col("_next") + 1, F.lit(len(order or ()) + 1)).cast("int"))
    follows = F.col("event_index").eqNullSafe(F.col("_next")) & F.col("previous_event_hash").eqNullSafe(F.col("_before"))
    fault = F.when(~follows, "STALE").when(F.lit(bool(order)) & ~turn.eqNullSafe(F.col("event_type")), "STATE").when(~F.col("event_hash").eqNullSafe(F.col("_own")), "DIGEST")
    rows = rows.withColumn("_fault", fault)
    first = F.row_number().over(Window.partitionBy("log_id", F.col("_fault").isNull()).orderBy("event_hash", F.xxhash64(*proposed.columns)))
    rows = rows.withColumn("code", F.coalesce("_fault", F.when(first == 1, "ACCEPTED").otherwise("LOST")))
    return rows.select(*proposed.columns, "code")


class Chains:
    """Logs in a folder: tables of events, and a numbered marker for each append that counts.

    A marker is created only if none of its number exists, which the file system decides; so of two writers that saw the
    same tails one wins, and the other looks again and is told STALE. A table without a marker is no part of the log.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.fs = self._at(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def commits(self) -> list[str]:
        """Names of the tables that count, in the order of their appends."""
        folder = self._at(f"{self.path}/commits")
        found = self.fs.listStatus(folder) if self.fs.exists(folder) else []
        return [self._named(f.getPath()) for f in sorted(found, key=lambda f: f.getPath().getName())]

    def _named(self, marker) -> str:
        """The table that a marker names; one that is just being written is waited for."""
        while self.fs.getFileStatus(marker).getLen() == 0:
            time.sleep(0.05)
        stream = self.fs.open(marker)
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def events(self, tables: list[str] | None = None) -> DataFrame:
        tables = self.commits() if tables is None else tables
        if not tables:
            return self.spark.createDataFrame([], EVENT)
        return self.spark.read.schema(EVENT).parquet(*[f"{self.path}/{t}" for t in tables])

    def append(self, proposed: DataFrame, digest: Column, order: Sequence[str] | None = CHRONOLOGY, seen: list[str] | None = None) -> DataFrame:
        """proposed with code; the accepted events are in the log. seen: commits that the writer looked at, for tests of races."""
        while True:
            tables = self.commits() if seen is None else seen
            name = f"events-{uuid.uuid4().hex}"
            said = decided(tails(self.events(tables)), proposed, digest, order)
            said.write.parquet(f"{self.path}/{name}-said")
            said = self.spark.read.schema(said.schema).parquet(f"{self.path}/{name}-said")
            said.filter("code = 'ACCEPTED'").select("log_id", "event_index", "event_type", "previous_event_hash", "event_hash").write.parquet(f"{self.path}/{name}")
            if self._claim(len(tables), name):
                return said
            seen = None

    def _claim(self, number: int, name: str) -> bool:
        """Whether the marker of this number is ours now."""
        try:
            stream = self.fs.create(self._at(f"{self.path}/commits/{number:010d}"), False)
        except Exception as error:
            if "FileAlreadyExistsException" in str(error) or "already exists" in str(error):
                return False
            raise
        stream.writeUTF(name)
        stream.close()
        return True
