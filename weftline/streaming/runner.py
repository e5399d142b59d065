"""Incremental runs: change packages as a stream of files, each routed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def run_packages(spark: SparkSession, source: str, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Read each new JSON package file once and hand batches (path, json) to ``handle``; the checkpoint makes it restartable."""
    files = spark.readStream.format("text").option("wholetext", True).schema("value string").load(source)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_versions(documents: DataFrame, key: str = "doc_id", text: str = "text", event_time: str | None = None, late: str = "1 day") -> DataFrame:
    """A stream without documents whose content was seen before.

    With a time, state is kept for ``late`` only; without one every (key, hash) is kept, so an endless stream needs a time.
    """
    hashed = documents.withColumn("sha256", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    if event_time:
        return hashed.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key, "sha256"])
    return hashed.dropDuplicates([key, "sha256"])
