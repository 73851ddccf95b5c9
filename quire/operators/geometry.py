"""Words to lines, reading order and paragraphs; page by page, so a page is the unit of work."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

LINE = "paper_version_id string, page int, line int, x0 double, y0 double, x1 double, y1 double, text string"


def lines(words: DataFrame, reach: float = 3.0, gap: float = 12.0) -> DataFrame:
    """(paper_version_id, page, x0, y0, x1, y1, text) words to lines.

    A word joins one of the last five lines whose mean top is within ``reach``; a
    horizontal gap over ``gap`` splits the line. Null words are dropped.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        groups: list[list[dict]] = []
        for w in pdf.dropna(subset=["text"]).sort_values(["y0", "x0"]).to_dict("records"):
            for g in reversed(groups[-5:]):
                if abs(sum(x["y0"] for x in g) / len(g) - w["y0"]) <= reach:
                    g.append(w)
                    break
            else:
                groups.append([w])
        out = []
        for g in groups:
            g.sort(key=lambda w: w["x0"])
            run_ = [g[0]]
            for w in g[1:]:
                if w["x0"] - run_[-1]["x1"] > gap:
                    out.append(run_)
                    run_ = []
                run_.append(w)
            out.append(run_)
        rows = [(*key, i, min(w["x0"] for w in r), min(w["y0"] for w in r), max(w["x1"] for w in r), max(w["y1"] for w in r), " ".join(w["text"] for w in r)) for i, r in enumerate(out)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in LINE.split(", ")])

    return words.groupBy("paper_version_id", "page").applyInPandas(run, LINE)


def reading_order(rows: DataFrame, width: float = 612.0) -> DataFrame:
    """Adds ``place``: two columns if each side has four lines and few cross, split by full-width lines, else top down."""
    page = W.partitionBy("paper_version_id", "page")
    mid = width / 2
    wide = (F.col("x1") - F.col("x0")) > width * 0.6
    left, right = ~wide & (F.col("x1") <= mid + 10), ~wide & (F.col("x0") >= mid - 10)
    cross = ~wide & ~left & ~right
    two = (F.sum(left.cast("int")).over(page) >= 4) & (F.sum(right.cast("int")).over(page) >= 4) & (F.sum(cross.cast("int")).over(page) <= 0.25 * F.count("*").over(page))
    part = F.sum(wide.cast("int")).over(page.orderBy("y0", "x0").rowsBetween(W.unboundedPreceding, 0))
    side = F.when(wide, -1).when(right, 1).otherwise(0)
    marked = rows.withColumn("_two", two).withColumn("_part", F.when(two, part).otherwise(0)).withColumn("_side", F.when(two, side).otherwise(0))
    return marked.withColumn("place", F.row_number().over(page.orderBy("_part", "_side", "y0", "x0")) - 1).drop("_two", "_part", "_side")


def paragraphs(ordered: DataFrame) -> DataFrame:
    """Lines in reading order to paragraphs: a new one at a gap over 1.1 line heights, or at a sentence end before a smaller gap or an indent."""
    page = W.partitionBy("paper_version_id", "page").orderBy("place")
    height = F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    prev = lambda c: F.lag(c).over(page)
    gap = F.col("y0") - prev("y1")
    ended = prev("text").rlike(r"[.!?。！？][\"')\]]*$")
    starts = prev("text").isNull() | (gap > 1.1 * height) | (gap < -height) | (ended & ((gap > 0.45 * height) | (F.col("x0") - prev("x0") > 7.2)))
    marked = ordered.withColumn("paragraph", F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(page.rowsBetween(W.unboundedPreceding, 0)))
    parts = F.array_join(F.array_sort(F.collect_list(F.struct("place", "text"))).text, "\n")
    text = F.regexp_replace(F.regexp_replace(parts, r"(?<=\p{L})-\n(?=\p{Ll})", ""), r"\n", " ")
    return marked.groupBy("paper_version_id", "page", "paragraph").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), text.alias("text")
    )


def grid(spans: DataFrame, edges: DataFrame, margin: float = 1.0) -> DataFrame:
    """(table_id, row, column, text): the span texts in the cells of their tables.

    ``spans`` are (table_id, x0, y0, x1, y1, text), ``edges`` (table_id, rows,
    columns) with sorted coordinates. A span falls in every cell whose bounds,
    widened by ``margin``, hold its anchor at 45 % of its width and height; texts of
    a cell follow the reading order of their middles. Columns without any text are
    left out and the others renumbered. A range join per table, never collected.
    """
    def bands(side: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(side) - 2), lambda i: F.struct(i.alias("at"), F.get(F.col(side), i).alias("lo"), F.get(F.col(side), i + 1).alias("hi")))

    apt = edges.where("size(rows) > 1 and size(columns) > 1")
    cells = apt.select("table_id", F.explode(bands("rows")).alias("r"), "columns").select("table_id", "r", F.explode(bands("columns")).alias("c"))
    anchor = spans.where("text is not null").select(
        "table_id", "text", (F.col("x0") + 0.45 * (F.col("x1") - F.col("x0"))).alias("cx"), (F.col("y0") + 0.45 * (F.col("y1") - F.col("y0"))).alias("cy"))
    within = (F.col("cy") >= F.col("r.lo") - margin) & (F.col("cy") <= F.col("r.hi") + margin) & (F.col("cx") >= F.col("c.lo") - margin) & (F.col("cx") <= F.col("c.hi") + margin)
    held = cells.join(anchor, "table_id").where(within).groupBy("table_id", F.col("r.at").alias("row"), F.col("c.at").alias("at")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cy", "cx", "text"))), lambda s: s["text"]), " ").alias("text"))
    used = held.groupBy("table_id").agg(F.array_sort(F.collect_set("at")).alias("used"))
    return held.join(used, "table_id").select("table_id", "row", (F.array_position("used", F.col("at")) - 1).cast("int").alias("column"), "text")


def merged_edges(values: list[float], near: float = 3.0) -> list[float]:
    """Sorted coordinates with neighbours within ``near`` merged to their running middle."""
    out: list[float] = []
    for v in sorted(values):
        if out and v - out[-1] <= near:
            out[-1] = (out[-1] + v) / 2
        else:
            out.append(v)
    return out
