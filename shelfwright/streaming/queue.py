"""The trigger queue as Structured Streaming: claimed once through the checkpoint, outcomes written per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state

TRIGGER = "timestamp string, event_type string, book_paths string, source string, book_id string, book_title string, author_name string, asin string"


def read_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Trigger files of a folder as a stream, with the time each file was last changed."""
    return spark.readStream.schema(TRIGGER).json(folder).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("changed_at"))


def trigger_paths(stream: DataFrame) -> DataFrame:
    """One row per path of each trigger; test events are ignored."""
    paths = F.filter(F.transform(F.split("book_paths", r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    return stream.where(~F.col("event_type").eqNullSafe("Test")).select("file", "event_type", "source", "book_id", "changed_at", F.explode(paths).alias("path"))


def consume(stream: DataFrame, process, out: str, checkpoint: str):
    """Process the queue: `process` maps a batch (file, path, ...) to rows with `ok`. A trigger is completed if all its paths are.

    Outcomes are written by batch id, so that a batch that runs again replaces its own.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        done = process(df).groupBy("file").agg(F.bool_and("ok").alias("ok"), F.count("*").alias("paths"))
        done.select("file", "paths", F.when(F.col("ok"), "completed").otherwise("failed").alias("outcome")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stable(files: DataFrame, seen: DataFrame, now, quiet: int = 120) -> DataFrame:
    """Folders to enqueue: stable, and neither seen nor queued before (seen: parent)."""
    return state.stable_folders(files, now, quiet).join(seen.select("parent").distinct(), "parent", "left_anti")
