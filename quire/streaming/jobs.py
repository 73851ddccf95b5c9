"""Structured Streaming forms of the job operators, and event windows with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def events(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet event files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def stage_state(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """First start, last end and largest ratio of each (job, stage), updated as events arrive."""
    return stream.withWatermark("ts", late).groupBy("job_id", "stage").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.max("ratio").alias("ratio"))


def windows(stream: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums per window and key; windows close once the watermark passes them."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    by = stream.withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(stream: DataFrame, gap: str, key: str, late: str = "10 minutes") -> DataFrame:
    """One row per burst of a key's events with no pause over ``gap``."""
    by = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), key).agg(F.count("*").alias("n"))
    return by.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def deduplicated(stream: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Each event once, though delivered again within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def publish(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]):
    """Run everything available through a micro-batch sink, then stop; restarts go on where it ended."""
    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return query


def bounded_tail(rows: DataFrame, key: str, order: list, size: int = 500) -> DataFrame:
    """The newest ``size`` events of each key: a full queue drops its oldest."""
    from quire.sources.tables import ranked

    return ranked(rows, [key], [c.desc() for c in order]).where(F.col("rank") <= size).drop("rank")
