"""Streams of frame windows, run events and frames; each has a batch form with the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from moltraj.schema import FRAME_WINDOWS, RUN_EVENTS

TICK = "5 seconds"
SNAPSHOT_SECONDS = 300


def read_folder(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def frame_windows(spark: SparkSession, path: str) -> DataFrame:
    return read_folder(spark, path, FRAME_WINDOWS)


def run_events(spark: SparkSession, path: str) -> DataFrame:
    return read_folder(spark, path, RUN_EVENTS)


def frame_progress(windows: DataFrame) -> DataFrame:
    """How far each trajectory has come; works on tables and, in update mode, on streams."""
    return windows.groupBy("trajectory_id").agg(
        F.max(F.col("start_frame") + F.col("frame_count")).alias("reached_frame"),
        F.sum("frame_count").alias("n_frames"),
        F.count(F.lit(1)).alias("n_windows"),
    )


def run_state(events: DataFrame) -> DataFrame:
    """Granted time, latest priority and whether each run is active, from submit / extend / terminate events."""
    granted = F.when(F.col("kind").isin("submit", "extend"), F.col("ns")).otherwise(F.lit(0.0))
    submitted = F.when(F.col("kind") == "submit", F.col("seq"))
    return events.groupBy("trajectory_id").agg(
        F.sum(granted).alias("budget_ns"),
        F.max_by("priority", submitted).alias("priority"),
        F.max_by("kind", "seq").alias("last_kind"),
    ).withColumn("active", F.col("last_kind") != "terminate")


def active_runs(events: DataFrame) -> DataFrame:
    return run_state(events).filter("active").drop("active")


def fresh_frames(frames: DataFrame, event_time: str, keys: list[str], lateness: str = "10 minutes") -> DataFrame:
    """Frames without repeats: a repeat of a key within the lateness is dropped, and state older than it is freed."""
    return frames.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(keys)


def ingest(frames: DataFrame, out: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Append each micro-batch under its own number; a batch that is replayed after a failure replaces itself."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = frames.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TICK)).start()


def snapshots(progress: DataFrame, out: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Write the complete progress table every few minutes, one folder per snapshot."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/snapshot={batch_id}")

    writer = progress.writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", checkpoint)
    every = {"availableNow": True} if once else {"processingTime": f"{SNAPSHOT_SECONDS} seconds"}
    return writer.trigger(**every).start()
