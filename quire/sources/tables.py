"""Parquet table source with the conventions every query shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """Read ``<root>/<name>.parquet`` and, when columns are named, only those."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


def latest(df: DataFrame, key: str | list[str], order: str | list[str] = "ingested_at") -> DataFrame:
    """One row per key: the last by ``order``; nulls lose, ties go to the larger row.

    ``max_by`` keeps the aggregation partial (map-side combine), so a key with a
    third of all rows never becomes one sort buffer. Rows with a null key form
    one group. An empty table gives an empty table.
    """
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in keys]
    simple = [c for c in rest if not df.schema[c].dataType.simpleString().startswith("map")]
    rank = F.struct(*[F.col(c) for c in orders], *[F.col(c) for c in simple if c not in orders])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), rank).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def ranked(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    """Number the rows of each key from 1 in the given order."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
