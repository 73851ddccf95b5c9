"""Terminology layers, translation memory and protected tokens."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from quire.functions.text import jaccard, plain_tokens, short_hash

# Layers of terms, the strongest first.
SCOPES = ["USER", "PAPER", "PROJECT", "DOMAIN", "SYSTEM"]


def resolve(terms: DataFrame) -> DataFrame:
    """One entry per lower-case source: the strongest scope, locked before open, then the surer, then by target."""
    place = F.array_position(F.array(*[F.lit(s) for s in SCOPES]), F.upper("scope"))
    order = F.struct(F.when(place == 0, 99).otherwise(place), (~F.coalesce("locked", F.lit(False))).alias("open"), (-F.coalesce("confidence", F.lit(0.0))).alias("doubt"), F.col("target"))
    best = terms.where("source is not null").groupBy(F.lower("source").alias("key")).agg(F.min_by(F.struct("source", "target", "scope"), order).alias("t"))
    return best.select("key", "t.source", "t.target", "t.scope")


def scan(texts: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """(key, source, times): occurrences of each term, counted without overlap and without case; the term list is small."""
    low = F.lower(text)
    both = texts.where(F.col(text).isNotNull()).join(F.broadcast(terms.select("source").distinct()), F.contains(low, F.lower("source")))
    return both.select(key, "source", ((F.length(low) - F.length(F.replace(low, F.lower("source"), F.lit("")))) / F.length("source")).cast("int").alias("times"))


def drift(sources: DataFrame, targets: DataFrame, terms: DataFrame, on: list[str]) -> DataFrame:
    """(unit_id, sources): terms in a source text whose target is missing from a translation at the same place.

    ``sources`` holds unit_id, the place ``on`` and source_text, ``targets`` the place and
    target_text; a null translation lacks every target. Either side is cut to its terms
    before the two meet, and a place keeps each missing one once, so many texts on both
    sides of one place never form pairs.
    """
    terms = F.broadcast(terms.select("source", "target").distinct())
    said = sources.join(terms, F.contains(F.lower("source_text"), F.lower("source"))).select("unit_id", *on, "source", "target")
    lost = targets.join(terms, ~F.contains(F.lower(F.coalesce("target_text", F.lit(""))), F.lower("target"))).select(*on, "source", "target").distinct()
    hits = said.join(lost, [*on, "source", "target"], "left_semi")
    return hits.groupBy("unit_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def memory_key(text):
    """Content key of a source text: white space and case do not count."""
    return short_hash(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))))


def exact(units: DataFrame, memory: DataFrame) -> DataFrame:
    """Units with the stored translation of the same text; of several the best score, then the first by text."""
    best = memory.groupBy("source_hash").agg(F.max_by("translation", F.struct(F.coalesce("quality_score", F.lit(0.0)), "translation")).alias("translation"))
    return units.withColumn("source_hash", memory_key(F.col("source_text"))).join(best, "source_hash", "left")


def fuzzy(units: DataFrame, memory: DataFrame, least: float = 0.65) -> DataFrame:
    """(unit_id, source_hash, similarity): the most similar stored text by token Jaccard, at least ``least``.

    Two sets of that similarity share a token among the rarest of the unit, so
    units and entries meet on prefix tokens in order of frequency, never all
    against all. Ties go to the smaller hash.
    """
    u = units.select("unit_id", F.array_distinct(plain_tokens(F.col("source_text"))).alias("t"))
    m = memory.select("source_hash", F.array_distinct(plain_tokens(F.col("normalized_source"))).alias("t")).dropDuplicates(["source_hash"])
    seen = m.select(F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("n"))

    def prefix(df, key):
        rows = df.select(key, F.size("t").alias("size"), F.explode("t").alias("token")).join(seen, "token", "left")
        listed = rows.groupBy(key, "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("o"))
        keep = F.col("size") - F.ceil(F.col("size") * least) + 1
        return listed.select(key, F.explode(F.slice("o.token", F.lit(1), keep.cast("int"))).alias("token"))

    meet = prefix(u, "unit_id").join(prefix(m, "source_hash"), "token").select("unit_id", "source_hash").distinct()
    both = meet.join(u, "unit_id").join(m.withColumnRenamed("t", "s"), "source_hash")
    scored = both.select("unit_id", "source_hash", F.round(jaccard(F.col("t"), F.col("s")), 6).alias("similarity")).where(F.col("similarity") >= least)
    best = scored.groupBy("unit_id").agg(F.max_by(F.struct("source_hash", "similarity"), F.struct("similarity", F.translate("source_hash", "0123456789abcdef", "fedcba9876543210"))).alias("b"))
    return best.select("unit_id", "b.source_hash", "b.similarity")


_PROTECTED = [
    ("MATH", re.compile(r"\$[^$\n]+\$")),
    ("CITE", re.compile(r"\[[0-9]+(?:\s*[,–-]\s*[0-9]+)*\]|\([A-Z][\w\-]+(?: et al\.)?(?: and [A-Z][\w\-]+)?,? [12][0-9]{3}[a-z]?\)")),
    ("REF", re.compile(r"\b(?:Eq|Fig|Figure|Table|Tab|Section|Sec)\.?\s*\(?[0-9]+(?:\.[0-9]+)*\)?")),
    ("YEAR", re.compile(r"\b(?:18|19|20)[0-9]{2}\b")),
]
PROTECTED = StructType([StructField("text", StringType()), StructField("tokens", ArrayType(StringType()))])


def protect_text(text: str | None) -> tuple[str | None, list[str]]:
    """Citations, formulas, references and years replaced by numbered marks, in order of kind and place."""
    tokens: list[str] = []
    if text is None:
        return None, tokens
    for kind, pattern in _PROTECTED:

        def mark(m: re.Match) -> str:
            if "⟦" in m.group():
                return m.group()
            tokens.append(m.group())
            return f"⟦{kind}_{len(tokens) - 1:03d}⟧"

        text = pattern.sub(mark, text)
    return text, tokens


def restore_text(text: str | None, tokens) -> str | None:
    """The marks put back; a token may hold marks of earlier ones."""
    if text is None:
        return None
    for i in reversed(range(len(tokens))):
        text = re.sub(rf"⟦[A-Z]+_{i:03d}⟧", lambda m: tokens[i], text)
    return text


@F.pandas_udf(PROTECTED)
def protect(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([protect_text(t) for t in texts], columns=["text", "tokens"])


@F.pandas_udf(StringType())
def restore(texts: pd.Series, tokens: pd.Series) -> pd.Series:
    return pd.Series([restore_text(t, list(k) if k is not None else []) for t, k in zip(texts, tokens)])


def lost_tokens(units: DataFrame) -> DataFrame:
    """(unit_id, lost): protected tokens of the source that the translation lacks."""
    kept = F.filter("tokens", lambda t: ~F.contains(F.coalesce("target_text", F.lit("")), t))
    return units.select("unit_id", kept.alias("lost"))
