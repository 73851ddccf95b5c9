"""Checks of claims against quoted evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.text import casefold, collapse, numbers, sentences, short_hash

# Words that negate, and words that compare.
NEGATIONS = [
    "no", "not", "never", "without", "neither", "nor", "fail", "fails", "failed", "failure", "failures", "unable", "cannot", "prevent",
    "prevents", "prevented", "ignore", "ignores", "ignored", "ignoring", "lack", "lacks", "lacking", "unreliable", "unreliability",
    "inconsistent", "insufficient", "unnecessary", "unstable", "impossible", "difficult", "hardly", "rarely", "avoid", "avoids", "avoided",
    "unavoidable",
]
NEGATIONS_ZH = ["不", "没有", "没", "未", "无", "无需", "不用", "避免", "无法", "不能", "难以", "忽略"]
ZH_LONGEST_FIRST = "|".join(sorted(NEGATIONS_ZH, key=len, reverse=True))
COMPARATORS = [
    "higher", "lower", "increase", "decrease", "outperform", "improve", "worse", "drop", "drops", "dropped", "decline", "declines",
    "declined", "高于", "低于", "提高", "下降",
]


def negations(text: Column) -> Column:
    """Sorted distinct negations of a text: English ones as whole words, Chinese ones longest first and without overlap."""
    words = F.regexp_extract_all(casefold(text), F.lit("([a-z]+)"), 1)
    english = F.array_intersect(F.array_distinct(words), F.array(*[F.lit(w) for w in NEGATIONS]))
    chinese = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({ZH_LONGEST_FIRST})"), 1))
    return F.array_sort(F.concat(english, chinese))


def unsupported(claim: Column, context: Column) -> Column:
    """The negations of a claim that its context lacks: each English one itself, a Chinese one itself or in an English form."""
    forms = F.create_map(*[x for w in NEGATIONS_ZH for x in (F.lit(w), F.array(*[F.lit(n) for n in NEGATIONS]))])
    return F.filter(claim, lambda w: ~F.array_contains(context, w) & ~F.coalesce(F.arrays_overlap(context, forms[w]), F.lit(False)))


def comparators(text: Column) -> Column:
    """Comparing words that occur in a text as substrings."""
    return F.filter(F.array(*[F.lit(w) for w in COMPARATORS]), lambda w: F.contains(casefold(text), w))


def locate(links: DataFrame, ledger: DataFrame) -> DataFrame:
    """Validate (claim_id, evidence_id, quote, char_start, char_end) against (evidence_id, excerpt).

    Adds ``excerpt``, the re-anchored ``at`` (0-based) and ``reason``: unknown id,
    span out of range, or a quote that neither stands at its offset nor occurs
    exactly once. Null quotes and excerpts give a reason, never an error.
    """
    both = links.join(ledger.select("evidence_id", "excerpt"), "evidence_id", "left")
    there = F.substring("excerpt", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("quote")
    gone = F.length("excerpt") - F.length(F.replace("excerpt", "quote", F.lit("")))
    times = F.when(F.length("quote") > 0, gone / F.length("quote")).otherwise(0)
    reason = (
        F.when(F.col("excerpt").isNull(), "UNKNOWN_EVIDENCE_ID")
        .when((F.col("char_start") < 0) | (F.col("char_end") > F.length("excerpt")) | (F.col("char_start") >= F.col("char_end")), "QUOTE_SPAN_OUT_OF_RANGE")
        .when(there | (times == 1), None)
        .otherwise("QUOTE_NOT_UNIQUE_LITERAL_SUBSTRING")
    )
    at = F.when(there, F.col("char_start")).when(times == 1, F.instr("excerpt", F.col("quote")) - 1)
    return both.withColumn("reason", reason).withColumn("at", F.when(reason.isNull(), at))


def sentence_at(text: Column, at: Column) -> Column:
    """The sentence of a text that holds the character at a 0-based place."""
    upto, rest = F.substring(text, F.lit(1), at + 1), F.substring(text, at + 1, F.length(text))
    return F.concat(F.element_at(sentences(upto), -1), F.substring(F.get(sentences(rest), F.lit(0)), 2, 2147483647))


def guard(claims: DataFrame, links: DataFrame, ledger: DataFrame) -> DataFrame:
    """(claim_id, accepted, reasons): a claim stands if its quotes do and carry its numbers, negations and comparisons.

    Numbers compare by value and percent sign against the whole excerpts; each
    negation must stand in the sentence of a valid quote's (re-anchored) place.
    Claims without any valid quote are rejected. Null texts count as empty.
    """
    checked = locate(links, ledger)
    valid = F.col("reason").isNull()
    said = F.when(valid, F.col("excerpt")).otherwise("")
    context = F.when(valid, sentence_at(F.col("excerpt"), F.col("at"))).otherwise("")
    by = checked.groupBy("claim_id").agg(
        F.collect_set("reason").alias("bad"), F.count_if(valid).alias("valid"),
        F.array_distinct(F.flatten(F.collect_list(numbers(said)))).alias("has_numbers"),
        F.array_distinct(F.flatten(F.collect_list(negations(context)))).alias("has_negations"),
        F.array_distinct(F.flatten(F.collect_list(comparators(said)))).alias("has_comparators"),
    )
    empty = F.array().cast("array<string>")
    has = lambda name: F.coalesce(name, empty)
    text = F.coalesce("text", F.lit(""))
    missing = F.transform(F.array_except(numbers(text), has("has_numbers")), lambda x: F.concat(F.lit("NUMBER_NOT_IN_EVIDENCE:"), x))
    reasons = F.array_compact(
        F.array(
            F.when(F.coalesce("valid", F.lit(0)) == 0, "CLAIM_HAS_NO_VALID_EVIDENCE"),
            F.when(F.size(unsupported(negations(text), has("has_negations"))) > 0, "NEGATION_CONTEXT_MISMATCH"),
            F.when((F.size(comparators(text)) > 0) & (F.size(has("has_comparators")) == 0), "COMPARISON_DIRECTION_UNSUPPORTED"),
        )
    )
    every = F.array_sort(F.array_distinct(F.concat(has("bad"), reasons, missing)))
    return claims.join(by, "claim_id", "left").select("claim_id", (F.size(every) == 0).alias("accepted"), every.alias("reasons"))


def finalize(checked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(claim_id, accepted, reasons) after the semantic verdicts (claim_id, verdict): a missing or other verdict than SUPPORTED rejects."""
    both = checked.join(verdicts.groupBy("claim_id").agg(F.max("verdict").alias("verdict")), "claim_id", "left")
    more = F.when(F.col("verdict").isNull(), F.array(F.lit("SEMANTIC_VERDICT_MISSING"))).when(F.col("verdict") != "SUPPORTED", F.array(F.concat(F.lit("SEMANTIC_"), "verdict"))).otherwise(F.array().cast("array<string>"))
    reasons = F.array_sort(F.array_distinct(F.concat("reasons", more)))
    return both.select("claim_id", (F.size(reasons) == 0).alias("accepted"), reasons.alias("reasons"))


def ledger_from_hits(hits: DataFrame) -> DataFrame:
    """(evidence_id, chunk_id, excerpt, page_start, page_end, section_path, label) of ranked hits; the id is fixed by chunk and text."""
    page = F.when(F.col("page_start").eqNullSafe(F.col("page_end")), F.concat(F.lit("p."), F.coalesce(F.col("page_start").cast("string"), F.lit("None")))).otherwise(
        F.concat(F.lit("pp."), F.coalesce(F.col("page_start").cast("string"), F.lit("None")), F.lit("-"), F.coalesce(F.col("page_end").cast("string"), F.lit("None"))))
    label = F.concat(F.lit("[Paper, PDF "), page, F.lit(", "), collapse(F.coalesce("section_path", F.lit(""))), F.lit("]"))
    return hits.select(short_hash(F.col("chunk_id"), F.coalesce("text", F.lit(""))).alias("evidence_id"), "chunk_id", F.col("text").alias("excerpt"), "page_start", "page_end", "section_path", label.alias("label"))
