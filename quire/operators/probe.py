"""What kind of document a parse is, which backends to try, which layout template it follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def report(pages: DataFrame) -> DataFrame:
    """(doc_id, pages, coverage, scanned_ratio, columns, table_pages, formula_pages, kind).

    Pages are (doc_id, page, text_chars, image_boxes, table_lines, formula_symbols,
    x0s). A page of under 50 characters with an image is scanned; over 60 % scanned
    is SCANNED, over 15 % MIXED, else BORN_DIGITAL from 40 % coverage, else UNKNOWN.
    """
    scanned = ((F.col("text_chars") < 50) & (F.col("image_boxes") > 0)).cast("int")
    columns = F.size(F.array_distinct(F.transform(F.coalesce("x0s", F.array().cast("array<double>")), lambda x: F.round(x / 20))))
    by = pages.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.round(F.avg(F.least(F.lit(1.0), F.col("text_chars") / 2200)), 4).alias("coverage"), F.round(F.avg(scanned), 4).alias("scanned_ratio"),
        F.max(F.when(columns >= 2, 2).otherwise(1)).alias("columns"), F.count_if(F.col("table_lines") > 4).alias("table_pages"), F.count_if(F.col("formula_symbols") > 8).alias("formula_pages"),
    )
    kind = F.when(F.col("scanned_ratio") > 0.6, "SCANNED").when(F.col("scanned_ratio") > 0.15, "MIXED").when(F.col("coverage") > 0.4, "BORN_DIGITAL").otherwise("UNKNOWN")
    return by.withColumn("kind", kind)


def plan(reports: DataFrame, backends: DataFrame) -> DataFrame:
    """(doc_id, backend, place): backends that offer what a document needs, the best first; OCR only for repairs of scanned ones.

    Backends are the fixed list (backend, capability, preference).
    """
    needs = F.array_compact(F.array(F.lit("text"), F.when(F.col("table_pages") > 0, "tables"), F.when(F.col("formula_pages") > 0, "formulas"), F.when(F.col("kind") == "SCANNED", "ocr")))
    each = reports.select("doc_id", F.explode(needs).alias("capability"))
    offers = each.join(F.broadcast(backends), "capability").groupBy("doc_id", "backend").agg(F.count("*").alias("meets"), F.max("preference").alias("preference"))
    place = F.struct((-F.col("meets")).alias("m"), (-F.col("preference")).alias("p"), F.col("backend"))
    ordered = offers.groupBy("doc_id").agg(F.array_sort(F.collect_list(place)).alias("o"))
    return ordered.select("doc_id", F.posexplode("o.backend").alias("place", "backend"))


def template(prints: DataFrame, templates: DataFrame, least: float = 2.5) -> DataFrame:
    """(doc_id, template, score): the best template of equal column count, if it scores enough.

    One point for widths within 6, half each for font within .5 and line height
    within 1.5, one and a half for every column edge within 8. The registry is a
    fixed small table.
    """
    both = prints.join(F.broadcast(templates.select("template", *[F.col(c).alias(f"t_{c}") for c in ("columns", "width", "font", "line", "edges")])), F.col("columns") == F.col("t_columns"))
    near = lambda c, d: (F.abs(F.col(c) - F.col(f"t_{c}")) < d).cast("double")
    edges = F.size(F.filter("edges", lambda e: F.exists("t_edges", lambda t: F.abs(e - t) < 8)))
    score = near("width", 6) + 0.5 * near("font", 0.5) + 0.5 * near("line", 1.5) + 1.5 * edges
    best = both.select("doc_id", "template", score.alias("score")).groupBy("doc_id").agg(F.max_by(F.struct("template", "score"), F.struct("score", "template")).alias("b"))
    return best.select("doc_id", "b.template", "b.score").where(F.col("score") >= least)
