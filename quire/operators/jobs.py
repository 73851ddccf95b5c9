"""Jobs from their stage events, in batch; the streaming form is in quire.streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Weight of each stage in a job's progress.
WEIGHTS = {
    "file_validation": 0.05, "metadata_and_pages": 0.10, "layout_and_text": 0.25, "sections": 0.12,
    "assets": 0.18, "references": 0.10, "index": 0.10, "initial_translation": 0.10,
}


def progress(events: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(job_id, progress): sum of weight times the largest ratio of each stage, at most 1."""
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    by = events.groupBy("job_id", "stage").agg(F.max("ratio").alias("ratio"))
    return by.groupBy("job_id").agg(F.round(F.least(F.lit(1.0), F.sum(F.coalesce(w[F.col("stage")], F.lit(0.0)) * F.col("ratio"))), 6).alias("progress"))


def stages(events: DataFrame) -> DataFrame:
    """(job_id, stage, started, ended, seconds): first start kept, last end; one event is an instant stage."""
    by = events.groupBy("job_id", "stage").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"))
    return by.withColumn("seconds", (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / 1e6)


def tally(events: DataFrame, key: str, status: str, names: list[str]) -> DataFrame:
    """One row per key with the count of each status."""
    return events.groupBy(key).agg(*[F.count_if(F.col(status) == n).alias(n) for n in names])
