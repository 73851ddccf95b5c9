"""Queries of the training-text operators, by problem; the SQL sits beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import languages, leaks, mixing, names, neardup, pieces, scans, scripts, works
from quire.sources.tables import table


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return scans.found(table(spark, root, "blocks"))


def p2_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    return scans.paragraphs(table(spark, root, "blocks"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return scripts.found(table(spark, root, "blocks"), table(spark, root, "sections"))


def p3_consistent(spark: SparkSession, root: str) -> DataFrame:
    blocks = table(spark, root, "blocks", "block_id", "text")
    return scripts.consistent(blocks, "text")


def p3_titles(spark: SparkSession, root: str) -> DataFrame:
    return scripts.consistent(table(spark, root, "sections", "section_id", "title"), "title")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return neardup.found(table(spark, root, "blocks"))


def p4_classes(spark: SparkSession, root: str) -> DataFrame:
    return neardup.classes(table(spark, root, "blocks"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return names.found(table(spark, root, "papers"), table(spark, root, "provider_records"))


def p5_entities(spark: SparkSession, root: str) -> DataFrame:
    return names.linked(table(spark, root, "papers"), table(spark, root, "provider_records"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return languages.found(table(spark, root, "documents"))


def p10_segments(spark: SparkSession, root: str) -> DataFrame:
    return languages.segments(table(spark, root, "documents"))


def p10_labels(spark: SparkSession, root: str) -> DataFrame:
    return languages.labels(table(spark, root, "documents"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return pieces.found(table(spark, root, "chunks"))


def p6_pieces(spark: SparkSession, root: str) -> DataFrame:
    return pieces.within(table(spark, root, "chunks"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return works.found(table(spark, root, "provider_records"))


def p7_matches(spark: SparkSession, root: str) -> DataFrame:
    return works.matched(table(spark, root, "provider_records"))


def p9_mixture(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mixture(table(spark, root, "documents"), table(spark, root, "source_targets"))


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixing.shares(table(spark, root, "documents"), table(spark, root, "source_targets"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return leaks.found(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p8_report(spark: SparkSession, root: str) -> DataFrame:
    return leaks.report(table(spark, root, "documents"), table(spark, root, "eval_items"))


QUERIES = {
    "p2_found": p2_found, "p2_paragraphs": p2_paragraphs, "p3_found": p3_found, "p3_consistent": p3_consistent, "p3_titles": p3_titles,
    "p4_found": p4_found, "p4_classes": p4_classes, "p6_found": p6_found, "p6_pieces": p6_pieces,
    "p5_found": p5_found, "p5_entities": p5_entities, "p8_found": p8_found, "p8_report": p8_report,
    "p7_found": p7_found, "p7_matches": p7_matches, "p9_mixture": p9_mixture, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_segments": p10_segments, "p10_labels": p10_labels,
}

SQL: dict[str, str] = {
    # Tokens by their definition: runs of ASCII word characters, CJK characters, a third of the other marks.
    "p6_found": r"""
        SELECT DISTINCT chunk_id FROM chunks
        WHERE chunk_id IS NOT NULL AND len(regexp_extract_all(text, '[A-Za-z0-9_]+')) + len(regexp_extract_all(text, '[\x{3400}-\x{9FFF}]'))
            + len(regexp_extract_all(text, '[^\p{L}\p{N}_\s]')) // 3 > 650
    """,
    # Ten words in a row, by every window of every text.
    "p8_found": r"""
        WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        i AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
        dw AS (SELECT id, array_to_string(w[k:k + 9], ' ') AS said FROM d, unnest(range(1, len(w) - 8)) AS t(k)),
        iw AS (SELECT id, array_to_string(w[k:k + 9], ' ') AS said FROM i, unnest(range(1, len(w) - 8)) AS t(k))
        SELECT DISTINCT dw.id AS doc_id, iw.id AS item_id FROM dw JOIN iw USING (said)
    """,
}
