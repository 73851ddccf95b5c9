"""Translation runs as DataFrames: context, terms, protection, memory, checks, repairs.

The model stays outside: its answers are a DataFrame (unit_id, answer).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from quire.operators.terms import exact, memory_key, protect, restore


def prepared(units: DataFrame, memory: DataFrame, terms: DataFrame) -> DataFrame:
    """Units (unit_id, doc_id, place, source_text) with all a model needs.

    Adds ``translation`` where the memory holds the same text (such units skip the
    model), the protected ``text`` with its ``tokens``, the texts before and after,
    and the terms that occur. Null sources stay null throughout.
    """
    order = W.partitionBy("doc_id").orderBy("place", "unit_id")
    known = exact(units, memory)
    near = known.withColumn("before", F.lag("source_text").over(order)).withColumn("after", F.lead("source_text").over(order))
    hits = units.join(F.broadcast(terms), F.contains(F.lower("source_text"), F.lower("source"))).groupBy("unit_id").agg(
        F.array_sort(F.collect_set(F.struct("source", "target"))).alias("terms")
    )
    out = near.join(hits, "unit_id", "left").withColumn("_p", protect(F.col("source_text")))
    return out.withColumn("text", F.col("_p.text")).withColumn("tokens", F.col("_p.tokens")).drop("_p")


def verified(ready: DataFrame, answers: DataFrame) -> DataFrame:
    """(unit_id, target_text, status, reasons): memory hits and checked answers.

    An answer is DONE if every mark came back, every term's target stands in it and
    it is not empty; else NEEDS_RETRY with the reasons. No answer is NEEDS_RETRY.
    """
    both = ready.join(answers.select("unit_id", "answer"), "unit_id", "left")
    text = F.coalesce("translation", restore(F.col("answer"), F.col("tokens")))
    out = both.withColumn("target_text", text)
    empty = F.array().cast("array<string>")
    lost = F.filter(F.coalesce("tokens", empty), lambda t: ~F.contains(F.coalesce("target_text", F.lit("")), t))
    missed = F.filter(F.coalesce(F.col("terms.target"), empty), lambda t: ~F.contains(F.lower(F.coalesce("target_text", F.lit(""))), F.lower(t)))
    stored = F.col("translation").isNotNull()
    reasons = F.array_compact(F.array(
        F.when(F.coalesce(F.trim("target_text"), F.lit("")) == "", "EMPTY"), F.when(~stored & (F.size(lost) > 0), "LOST_TOKEN"), F.when(~stored & (F.size(missed) > 0), "MISSED_TERM"),
    ))
    return out.select("unit_id", "source_text", "target_text", F.when(F.size(reasons) == 0, "DONE").otherwise("NEEDS_RETRY").alias("status"), reasons.alias("reasons"))


def repairs(checked: DataFrame, most: int = 10) -> DataFrame:
    """The first failed units of a run with one instruction each."""
    return checked.where("status = 'NEEDS_RETRY'").orderBy("unit_id").limit(most).select("unit_id", F.concat(F.lit("Fix: "), F.array_join("reasons", ", ")).alias("instruction"))


def remembered(checked: DataFrame) -> DataFrame:
    """Memory rows of the units that passed; failed ones are never stored."""
    done = checked.where("status = 'DONE' and source_text is not null")
    return done.select(memory_key(F.col("source_text")).alias("source_hash"), F.col("source_text").alias("normalized_source"), F.col("target_text").alias("translation"), F.lit(1.0).alias("quality_score")).dropDuplicates(["source_hash"])
