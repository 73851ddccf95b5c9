"""Sinks: content-addressed publish, append without duplicates, partition replace, text exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def append_unseen(spark: SparkSession, rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the table at ``path`` does not hold; the number of rows written."""
    try:
        old = spark.read.parquet(path).select(key).distinct()
        rows = rows.join(old, key, "left_anti")
    except Exception as e:  # the table is made by its first append
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh = rows.dropDuplicates([key]).cache()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def replace_partitions(rows: DataFrame, path: str, *keys: str) -> None:
    """Overwrite only the partitions that the rows touch."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def stable_json(row: dict[str, Column]) -> Column:
    """Compact JSON with its keys in order."""
    return F.to_json(F.struct(*[row[k].alias(k) for k in sorted(row)]), {"ignoreNullFields": "false"})


def markdown_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line): a Markdown table of a small report, head and rule first, rows in the order of the columns."""
    bar = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", "\\\\|")
    spark = df.sparkSession
    head = spark.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + " --- |" * len(columns))], "k int, line string")
    body = df.select(F.lit(2).alias("k"), F.concat(F.lit("| "), F.concat_ws(" | ", *[bar(c) for c in columns]), F.lit(" |")).alias("line"))
    return head.unionByName(body).orderBy("k", "line").select("line")
