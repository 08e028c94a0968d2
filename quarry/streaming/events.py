"""Streaming forms: file watching, idempotent intake, receipt watermarks, lifecycle state, event-time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watch(spark: SparkSession, folder: str, schema, files_per_trigger: int = 8, glob: str | None = None) -> DataFrame:
    """A stream of the Parquet files that appear in a folder, a bounded number of them a trigger.

    The checkpoint of the query that reads it remembers which files were taken, so a restart resumes at
    the last published listing.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(folder)


def run_once(stream: DataFrame, place: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; appended Parquet is written exactly once."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", place).trigger(
        availableNow=True
    ).start().awaitTermination()


def run_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def idempotent(stream: DataFrame, key: list[str], at: str, late: str = "2 days") -> DataFrame:
    """One event a key; keys are forgotten once the watermark has passed them, so state stays bounded."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def windowed(stream: DataFrame, at: str, key: str, value: str, size: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums in tumbling or sliding event-time windows."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    rows = stream.withWatermark(at, late).groupBy(window, key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return rows.select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(stream: DataFrame, at: str, key: str, gap: str, late: str) -> DataFrame:
    rows = stream.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


class Outbox:
    """Applies events in id order above a watermark that only moves up: a replayed batch changes nothing.

    With a place the mark is written there after every batch, and a new Outbox goes on from it.  A batch
    whose mark was lost with the driver is applied again: what it applies to must bear that (keyed by id).
    """

    def __init__(self, id_col: str, apply: Callable[[DataFrame], None], start: int = -1, place: str | None = None):
        self.id_col, self.apply, self.mark, self.place = id_col, apply, start, place
        self.read = place is None

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        if not self.read:
            self._read_mark(batch.sparkSession)
        fresh = batch.filter(F.col(self.id_col) > self.mark)
        top = fresh.agg(F.max(self.id_col)).first()[0]
        if top is not None:
            self.apply(fresh)
            self.mark = top
            if self.place is not None:  # marks only grow, so an interrupted write leaves the last one in force
                batch.sparkSession.createDataFrame([(top, epoch)], "mark long, epoch long").coalesce(1).write.mode("append").parquet(self.place)

    def _read_mark(self, spark: SparkSession) -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.place)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            kept = spark.read.schema("mark long, epoch long").parquet(self.place).agg(F.max("mark")).first()[0]
            self.mark = max(self.mark, self.mark if kept is None else kept)
        self.read = True


#: What each event does to a run; others leave it as it is.
MOVES = {"signup": "planned", "view": "running", "click": "running", "purchase": "complete", "error": "failed"}


def lifecycle(stream: DataFrame, run: str, kind: str, at: str) -> DataFrame:
    """run, state, events after every batch: one small state a run; a finished run is not reopened."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, n = state.get if state.exists else ("new", 0)
        for pdf in batches:
            for event in pdf.sort_values("at")["kind"]:
                n += 1
                now = now if now == "complete" else MOVES.get(event, now)
        state.update((now, n))
        yield pd.DataFrame([(key[0], now, n)], columns=["run", "state", "events"])

    rows = stream.select(F.col(run).cast("long").alias("run"), F.col(kind).alias("kind"), F.col(at).alias("at"))
    return rows.groupBy("run").applyInPandasWithState(
        step, "run long, state string, events long", "state string, events long", "update", GroupStateTimeout.NoTimeout
    )
