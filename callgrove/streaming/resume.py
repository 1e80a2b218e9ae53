"""Streams: predictions appended batch by batch, and windowed event aggregates (an extension; the workflow itself has no stream operators)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.jsonx import response


def scored_responses(stream: DataFrame, output_format: str = "tagged") -> DataFrame:
    """A stream of (example_id, generated_text, ...) with its parsed responses; stateless."""
    return stream.withColumn("parsed", response(F.col("generated_text"), output_format))


def append_batches(stream: DataFrame, path: str, checkpoint: str, *, key: str = "example_id") -> StreamingQuery:
    """Appends each batch to a Parquet table once: a batch that is replayed after a failure replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, *, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per type and window of their time, with a watermark; the same plan on a batch or a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def stream_table(spark: SparkSession, folder: str, schema: str, pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def drained(stream: DataFrame, name: str, mode: str = "append", wrap: Callable | None = None) -> DataFrame:
    """What a bounded stream gives, through a memory sink; for tests."""
    query = (wrap(stream) if wrap else stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name)
