"""Streaming refresh: a stream of file versions is upserted into the index, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index as I
from ..shared import children, exists


def latest_versions(stream: DataFrame, key: str = "file_path", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The stream without repeated (key, content_hash) within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key, "content_hash"])


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of the table at path, ascending."""
    names = [n for n in children(spark, path) if n.startswith("v=")]
    return sorted(int(n[2:]) for n in names if exists(spark, f"{path}/{n}/_SUCCESS"))


def upsert_into(path: str, key: str = "file_path", ts: str = "ts"):
    """A foreachBatch function: merges a batch with the table's last complete version and writes the next one.

    Versions are folders numbered by the table itself, so a new checkpoint over an old
    table goes on from it. A batch that is run again makes one more version with the same
    rows, since the latest row of a key wins however often it comes.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark: SparkSession = batch.sparkSession
        known = versions(spark, path)
        stored = spark.read.schema(batch.schema).parquet(f"{path}/v={known[-1]}") if known else batch.where("false")
        following = known[-1] + 1 if known else 0
        I.upsert(stored, batch, [key], F.struct(F.col(ts), F.col("content_hash"))).write.mode("overwrite").parquet(f"{path}/v={following}")

    return merge


def run_available(stream: DataFrame, path: str, checkpoint: str, key: str = "file_path", ts: str = "ts") -> None:
    """Takes all that is there into the index at path and stops."""
    query = stream.writeStream.foreachBatch(upsert_into(path, key, ts)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, value: windowed counts with a watermark for late rows."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
