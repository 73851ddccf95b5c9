"""Keyed tables without in-place writes: keep latest, append unseen, expire, cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def append_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows and those new rows whose key is not there yet (insert or ignore)."""
    return old.unionByName(new.join(old.select(key).distinct(), key, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace old ones of the same key (insert or replace)."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the rows of the keys that are gone."""
    keys = gone.select(key).distinct()
    return parents.join(keys, key, "left_anti"), children.join(keys, key, "left_anti")


def alive(rows: DataFrame, stamp: str, seconds: int, now) -> DataFrame:
    """Rows whose time to live has not run out at ``now``."""
    return rows.where(F.col(stamp) + F.make_interval(secs=F.lit(seconds)) > now)


def neighbours(edges: DataFrame) -> DataFrame:
    """(node_id, neighbour, edge_type): both directions of each edge, once."""
    out = edges.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("neighbour"), "edge_type")
    back = edges.select(F.col("target_id").alias("node_id"), F.col("source_id").alias("neighbour"), "edge_type")
    return out.union(back).distinct()


def topological(tasks: list[str], needs: list[tuple[str, str]]) -> list[str]:
    """Order of a plan's few tasks: least name first among the ready, tasks of a cycle last by name."""
    wait = {t: {d for x, d in needs if x == t and d in tasks} for t in tasks}
    out: list[str] = []
    while ready := sorted(t for t in wait if t not in out and wait[t] <= set(out)):
        out.append(ready[0])
    return out + sorted(set(tasks) - set(out))
