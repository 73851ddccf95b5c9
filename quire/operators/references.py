"""Bibliographies: split, parse, check, bind and resolve references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions.text import jaccard, match_form

YEAR = r"(?:^|[^0-9.])((?:18|19|20)[0-9]{2})(?![0-9]|\.[0-9])"


def section(text: Column) -> Column:
    """Text between the references heading and the next closing heading; empty without one."""
    body = F.regexp_extract(text, r"(?ims)^\s*(?:[0-9]+\.?\s+)?(?:references|bibliography|参考文献)\s*$(.*)", 1)
    return F.regexp_replace(body, r"(?ims)^\s*(?:appendix|appendices|supplementary material|附录)\b.*", "")


def entries(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sequence_number, raw_text): numbered entries, else paragraphs, else lines."""
    body = F.col(text)
    numbered = F.split(body, r"(?m)(?=^\s*(?:\[[0-9]+\]|[0-9]{1,3}\.)\s)")
    parts = F.when(body.rlike(r"(?m)^\s*(?:\[[0-9]+\]|[0-9]{1,3}\.)\s"), numbered).when(body.rlike(r"\n\s*\n"), F.split(body, r"\n\s*\n")).otherwise(F.split(body, r"\n"))
    clean = F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: F.length(p) > 3)
    return texts.select(key, F.posexplode(clean).alias("p", "raw_text")).select(key, (F.col("p") + 1).alias("sequence_number"), "raw_text")


def doi(text: Column) -> Column:
    """The first DOI of a text, lower case, without closing marks."""
    found = F.regexp_extract(F.lower(text), r"\b(10\.[0-9]{4,9}/[^\s\"<>]+)", 1)
    return F.nullif(F.regexp_replace(found, r"[.,;:)\]}]+$", ""), F.lit(""))


def arxiv_id(text: Column) -> Column:
    """The first arXiv id: from a link, an explicit prefix, an old-style id or the whole string."""
    new = r"([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)"
    tries = [rf"(?i)arxiv\.org/(?:abs|pdf|html)/{new}", rf"(?i)arxiv[:\s]*{new}", rf"(?i)\babs/{new}", r"(?i)\b([a-z\-]+(?:\.[a-z]{2})?/[0-9]{7})(?![0-9])", rf"^\s*{new}\s*$"]
    return F.coalesce(*[F.nullif(F.regexp_extract(text, t, 1), F.lit("")) for t in tries])


def year(text: Column) -> Column:
    """A year that is no part of an identifier or decimal; null without one."""
    bare = F.regexp_replace(text, r"(?i)10\.[0-9]{4,9}/\S+|arxiv[:\s]*\S+|[0-9]{4}\.[0-9]{4,5}", " ")
    return F.regexp_extract(bare, YEAR, 1).try_cast("int")


def parse(refs: DataFrame) -> DataFrame:
    """Adds number, year, doi, arxiv_id, parsed_title, authors to rows with ``raw_text``; what is not found is null."""
    raw = F.col("raw_text")
    number = F.coalesce(F.nullif(F.regexp_extract(raw, r"^\s*\[([0-9]+)\]", 1), F.lit("")), F.nullif(F.regexp_extract(raw, r"^\s*([0-9]{1,3})\.\s", 1), F.lit(""))).cast("int")
    body = F.trim(F.regexp_replace(raw, r"^\s*(?:\[[0-9]+\]|[0-9]{1,3}\.)\s*", ""))
    quoted = F.regexp_extract(body, r"[“\"]([^”\"]{8,})[”\"]", 1)
    after_year = F.regexp_extract(body, r"\((?:18|19|20)[0-9]{2}[a-z]?\)\.?\s+([^.]{8,})\.", 1)
    second = F.regexp_extract(body, r"^.+?\p{Ll}{2,}\.\s+([^.]{12,})\.", 1)
    title = F.coalesce(*[F.nullif(F.trim(t), F.lit("")) for t in (quoted, after_year, second)])
    lead = F.regexp_extract(body, r"^(.{3,}?)(?:\s*[“\"(]|(?<=\p{Ll}{2})\.\s)", 1)
    people = F.filter(F.transform(F.split(lead, r",?\s+(?:and|&)\s+|;\s*|,\s+(?=\p{Lu}[\p{L}\-']+)"), lambda a: F.trim(a, F.lit(" ,."))), lambda a: F.length(a) > 2)
    return refs.withColumns({"number": number, "year": year(raw), "doi": doi(raw), "arxiv_id": arxiv_id(raw), "parsed_title": title, "authors": F.slice(people, 1, 8)})


def lint(refs: DataFrame, group: str) -> DataFrame:
    """Adds ``format_issues``: codes of what is wrong with each parsed reference within its list."""
    order = W.partitionBy(group).orderBy("sequence_number")
    twice = F.count("number").over(W.partitionBy(group, "number"))
    before = F.last("number", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    raw = F.col("raw_text")
    numbered = F.col("number").isNotNull()
    any_numbered = F.max(numbered.cast("int")).over(W.partitionBy(group))
    all_numbered = F.min(numbered.cast("int")).over(W.partitionBy(group))
    issues = F.array_compact(
        F.array(
            F.when(numbered & (twice > 1), "DUPLICATE_NUMBER"),
            F.when(numbered & before.isNotNull() & (F.col("number") != before + 1), "NON_SEQUENTIAL_NUMBER"),
            F.when((any_numbered == 1) & (all_numbered == 0) & ~numbered, "MIXED_STYLE"),
            F.when(F.col("year").isNull(), "MISSING_YEAR"),
            F.when(F.col("year") > F.year(F.current_date()) + 1, "YEAR_IN_FUTURE"),
            F.when(F.col("parsed_title").isNull(), "MISSING_TITLE"),
            F.when(F.length("parsed_title") < 10, "SHORT_TITLE"),
            F.when(F.size("authors") == 0, "MISSING_AUTHORS"),
            F.when(~raw.rlike(r"[.)\]]\s*$|\S+/\S+$"), "NO_FINAL_PERIOD"),
        )
    )
    return refs.withColumn("format_issues", issues)


def expand_group(group: Column) -> Column:
    """Numbers of a citation group such as ``3,5-8``; descending and very long ranges are dropped."""
    parts = F.regexp_extract_all(F.translate(group, "–—−", "---"), F.lit(r"([0-9]+(?:\s*-\s*[0-9]+)?)"), 1)
    a = lambda p: F.regexp_extract(p, "^([0-9]+)", 1).cast("int")
    b = lambda p: F.regexp_extract(p, "([0-9]+)$", 1).cast("int")
    fine = F.filter(parts, lambda p: (b(p) >= a(p)) & (b(p) - a(p) < 50))
    return F.flatten(F.transform(fine, lambda p: F.sequence(a(p), b(p))))


def callouts(blocks: DataFrame, references: DataFrame) -> DataFrame:
    """(paper_version_id, block_id, raw, number, reference_id): citation marks bound to the references of their version."""
    groups = blocks.select("paper_version_id", "block_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\[[0-9]+(?:\s*[,–—-]\s*[0-9]+)*\])"), 1)).alias("raw"))
    each = groups.withColumn("number", F.explode(expand_group(F.col("raw"))))
    return each.join(references.select("paper_version_id", F.col("sequence_number").alias("number"), "reference_id"), ["paper_version_id", "number"])


def resolve(refs: DataFrame, providers: DataFrame) -> DataFrame:
    """(reference_id, identifier, score, identity_status) of each reference.

    An equal DOI or arXiv id decides; else candidates share a title word key and
    the best of .55 title, .20 author, .15 year and .10 venue is PROBABLE from
    .78, AMBIGUOUS if the next is within .08, else UNRESOLVED.
    """
    core = lambda c: F.regexp_replace(c, r"v[0-9]+$", "")
    words = lambda c: F.array_distinct(F.split(match_form(c), " "))
    r = refs.select("reference_id", "doi", core("arxiv_id").alias("ax"), words("parsed_title").alias("t"), "year", F.lower(F.array_join("authors", " ")).alias("who"))
    p = providers.select("identifier", F.col("doi").alias("p_doi"), core("arxiv_id").alias("p_ax"), words("title").alias("p_t"), F.col("year").alias("p_year"), F.regexp_replace(F.lower(F.array_join("authors", " ")), r"[^\p{L}]+", " ").alias("p_who"))
    by_id = r.join(p, F.lower("doi") == F.lower("p_doi")).unionByName(r.join(p, F.col("ax") == F.col("p_ax")))
    sim = jaccard(F.col("t"), F.col("p_t"))
    near = F.when(F.col("year") == F.col("p_year"), 1.0).when(F.abs(F.col("year") - F.col("p_year")) == 1, 0.5).otherwise(0.0)
    known = F.exists(F.filter(F.split("p_who", " "), lambda w: F.length(w) > 3), lambda w: F.contains(F.col("who"), w)).cast("double")
    score = F.round(0.55 * sim + 0.20 * F.coalesce(known, F.lit(0.0)) + 0.15 * near, 4)
    exact = by_id.select("reference_id", "identifier", F.lit(1.0).alias("score"), F.when(sim >= 0.9, "VERIFIED").otherwise("CONFLICT").alias("identity_status"))
    first = exact.groupBy("reference_id").agg(F.min(F.struct("identity_status", "identifier", "score")).alias("e"))
    # Candidates share the two longest title words: a key, not all pairs.
    key = lambda t: F.array_join(F.slice(F.array_sort(t, lambda x, y: F.length(y) - F.length(x)), 1, 1), " ")
    open_ = r.join(first.select("reference_id"), "reference_id", "left_anti").withColumn("key", key(F.col("t")))
    c = open_.join(p.withColumn("key", key(F.col("p_t"))), "key").select("reference_id", "identifier", score.alias("score"))
    ranked = c.withColumn("k", F.row_number().over(W.partitionBy("reference_id").orderBy(F.desc("score"), "identifier"))).withColumn("next", F.lead("score").over(W.partitionBy("reference_id").orderBy(F.desc("score"), "identifier"))).where("k = 1")
    status = F.when((F.col("score") >= 0.78) & (F.col("score") - F.coalesce("next", F.lit(0.0)) < 0.08), "AMBIGUOUS").when(F.col("score") >= 0.78, "PROBABLE").otherwise("UNRESOLVED")
    guessed = ranked.select("reference_id", "identifier", "score", status.alias("identity_status"))
    got = first.select("reference_id", "e.identifier", "e.score", "e.identity_status").unionByName(guessed)
    return refs.select("reference_id").join(got, "reference_id", "left").fillna("UNRESOLVED", ["identity_status"])
