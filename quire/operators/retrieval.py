"""Ranked retrieval: BM25, dense similarity, fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions.text import plain_tokens, rank_tokens
from quire.session import durable, spread

K1, B = 1.5, 0.75


def bm25(corpus: DataFrame, queries: DataFrame, key: str, text: str, k: int, tokens=rank_tokens, boost: Column | None = None, least_average: float = 1.0) -> DataFrame:
    """(query_id, key, score, rank): the ``k`` best units of each query by Okapi BM25.

    ``queries`` is a small frame (query_id, query) whose terms count as often as
    they are repeated. Lengths and document frequencies are those of the whole
    corpus; only tokens that some query asks for are exploded, and frequencies
    are summed before they are shuffled. Scores of zero are no hits; ties go to
    the smaller key. Empty corpora, queries and null texts give no rows.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    wanted = F.broadcast(asked.agg(F.collect_set("term").alias("wanted")))
    extra = [boost.alias("boost")] if boost is not None else []
    units = spread(corpus.where(F.col(text).isNotNull())).select(F.col(key), tokens(F.col(text)).alias("t"), *extra)
    units = units.crossJoin(wanted).select(
        key, F.size("t").alias("length"), F.filter("t", lambda x: F.array_contains("wanted", x)).alias("hits"), *(["boost"] if extra else [])
    )
    units = durable(units)  # tokenised once for lengths, frequencies and scores
    totals = units.agg(F.count("*").alias("units"), F.avg("length").alias("average"))
    tf = units.select(key, "length", F.explode("hits").alias("term"), *(["boost"] if extra else [])).groupBy(key, "length", "term", *(["boost"] if extra else [])).agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    terms = asked.join(df, "term").crossJoin(totals)
    idf = F.log(1 + (F.col("units") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (
        F.col("tf") + K1 * (1 - B + B * F.col("length") / F.greatest(F.when(F.col("average") > 0, F.col("average")).otherwise(1.0), F.lit(least_average)))
    )
    scored = tf.join(F.broadcast(terms), "term").groupBy("query_id", key, *(["boost"] if extra else [])).agg(F.sum(part).alias("score"))
    if extra:
        scored = scored.withColumn("score", F.col("score") * F.col("boost"))
    return top(scored.select("query_id", key, F.round("score", 6).alias("score")).where("score > 0"), ["query_id"], [F.desc("score"), F.asc(key)], k)


def lexical(corpus: DataFrame, queries: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """BM25 over plain words, with an average length of at least one."""
    return bm25(corpus, queries, key, text, k, tokens=plain_tokens)


def top(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each key with their rank; Spark cuts before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def dense(vectors: DataFrame, query: list[float], key: str, column: str, k: int) -> DataFrame:
    """(key, score, rank): the ``k`` rows of largest cosine with the query; zero vectors score zero."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(column, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(F.transform(column, lambda a: a.cast("double") * a.cast("double")), F.lit(0.0), lambda s, x: s + x))
    size = sum(x * x for x in query) ** 0.5
    cosine = F.when(norm * size == 0, 0.0).otherwise(dot / (norm * size))
    best = vectors.select(key, F.round(cosine, 5).alias("score")).orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("score"), key)))


def fuse(rankings: DataFrame, key: str, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (source, key, rank): score, rank and the sources of each unit."""
    fused = rankings.groupBy(key).agg(
        F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"), F.array_sort(F.collect_set("source")).alias("sources")
    )
    best = fused.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(F.desc("score"), key)))


def sufficient(hits: DataFrame, corpus: DataFrame, queries: DataFrame, key: str, text: str, look: int = 5) -> DataFrame:
    """(query_id, is_sufficient): whether one of the first hits shares two query terms, or the only one.

    Terms are ranking tokens of more than one character or a digit.
    """
    useful = lambda c: F.array_distinct(F.filter(rank_tokens(c), lambda t: (F.length(t) > 1) | t.rlike("^[0-9]$")))
    asked = queries.select("query_id", useful(F.col("query")).alias("asked"))
    near = hits.where(F.col("rank") <= look).join(corpus.select(key, useful(F.col(text)).alias("has")), key)
    shared = near.join(F.broadcast(asked), "query_id").select("query_id", F.size(F.array_intersect("asked", "has")).alias("n"), F.size("asked").alias("m"))
    good = shared.groupBy("query_id").agg(F.bool_or((F.col("m") > 0) & (F.col("n") >= F.least(F.lit(2), F.col("m")))).alias("ok"))
    return queries.select("query_id").join(good, "query_id", "left").select("query_id", F.coalesce("ok", F.lit(False)).alias("is_sufficient"))
