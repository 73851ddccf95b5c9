"""Results of several papers side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Other names of data sets.
DATASETS = {"coco val2017": "coco", "coco test dev": "coco", "ms coco": "coco", "imagenet val": "imagenet", "imagenet 1k": "imagenet"}


def key_name(name: Column) -> Column:
    """Lower case, separators to one blank, known aliases resolved; null becomes empty."""
    base = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"[_\- ]+", " ")
    out = base
    for alias, dataset in DATASETS.items():
        out = F.when(base == alias, dataset).otherwise(out)
    return out


def aligned(results: DataFrame) -> DataFrame:
    """(dataset, task, metric, records, papers, best): results grouped by their normalised key."""
    keyed = results.withColumns({c: key_name(F.col(c)) for c in ("dataset", "task", "metric")})
    return keyed.groupBy("dataset", "task", "metric").agg(
        F.count("*").alias("records"), F.count_distinct("paper_id").alias("papers"), F.max(F.when(~F.isnan("value"), F.col("value"))).alias("best")
    )


def matrix(results: DataFrame, columns: list[str], by: str) -> DataFrame:
    """One row per normalised key, one column per listed value of ``by`` with the mean."""
    keyed = results.withColumns({c: key_name(F.col(c)) for c in ("dataset", "metric")}).where(~F.isnan("value"))
    return keyed.groupBy("dataset", "metric").pivot(by, columns).agg(F.round(F.avg("value"), 4))


def compared(results: DataFrame) -> DataFrame:
    """(dataset, metric, papers, same_key, best_paper): last value of each paper, comparable while conditions agree.

    Empty conditions agree with any; the best paper is the largest value, ties to
    the smaller id, and only named where the conditions agree.
    """
    last = results.groupBy("dataset", "metric", "paper_id").agg(F.max_by(F.struct("value", "condition"), F.struct("ingested_at", "result_id")).alias("r"))
    by = last.groupBy("dataset", "metric").agg(
        F.count("*").alias("papers"),
        (F.count_distinct(F.nullif("r.condition", F.lit(""))) <= 1).alias("same_key"),
        F.min_by("paper_id", F.struct(-F.col("r.value"), F.col("paper_id"))).alias("_any"),
        F.min(F.when(F.col("r.value").isNotNull() & ~F.isnan("r.value"), F.struct((-F.col("r.value")).alias("v"), F.col("paper_id").alias("p")))).alias("best"),
    )
    return by.select("dataset", "metric", "papers", "same_key", F.when(F.col("same_key"), F.col("best.p")).alias("best_paper"))


def densified(cells: DataFrame, papers: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Every dimension of every paper: the cell's value, or NOT_FOUND. Both lists are those of one comparison."""
    grid = papers.select("paper_id").distinct().crossJoin(F.broadcast(dimensions.select("dimension").distinct()))
    return grid.join(cells, ["paper_id", "dimension"], "left").withColumn("status", F.when(F.col("value").isNull(), "NOT_FOUND").otherwise("FOUND"))


def gaps(cells: DataFrame, papers: int) -> DataFrame:
    """(dimension, missing): how many of the papers have no value in a dimension."""
    return cells.groupBy("dimension").agg((F.lit(papers) - F.count_distinct(F.when(F.col("value").isNotNull(), F.col("paper_id")))).alias("missing"))


def consensus(cells: DataFrame) -> DataFrame:
    """(dimension, value, support, papers): the commonest value where at least half of two or more papers agree."""
    votes = cells.where("value is not null").groupBy("dimension", "value").agg(F.count_distinct("paper_id").alias("support"))
    by = cells.where("value is not null").groupBy("dimension").agg(F.count_distinct("paper_id").alias("papers"))
    best = votes.groupBy("dimension").agg(F.min_by(F.struct("value", "support"), F.struct(-F.col("support"), F.col("value"))).alias("b"))
    out = best.join(by, "dimension").select("dimension", "b.value", "b.support", "papers")
    return out.where((F.col("papers") >= 2) & (F.col("support") >= F.greatest(F.lit(2), F.ceil(F.col("papers") / 2))))


def rubric(scores: DataFrame, weights: DataFrame, least: float = 0.7) -> DataFrame:
    """(paper_id, coverage, total): weighted score of 0..4 marks; null under the least coverage of weights."""
    both = scores.join(F.broadcast(weights), "dimension").where("score between 0 and 4")
    all_ = weights.agg(F.sum("weight").alias("all_weight"))
    by = both.groupBy("paper_id").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("score") / 4).alias("s")).crossJoin(F.broadcast(all_))
    cover = F.col("w") / F.col("all_weight")
    return by.select("paper_id", F.round(cover, 4).alias("coverage"), F.when(cover >= least, F.round(F.col("s"), 4)).alias("total"))
