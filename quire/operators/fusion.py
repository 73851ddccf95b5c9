"""Several parses of one document: scores, clusters, the best of each region, repairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quire.functions.text import jaccard, plain_tokens


def box_overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; a union under one counts as one."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    return w * h / F.greatest(F.lit(1.0), area(a) + area(b) - w * h)


def candidate_score() -> Column:
    """Confidence, less 0.2 for short text that is no figure or formula; -1 without text."""
    short = (F.length("text") < 8) & ~F.lower("kind").isin("figure", "formula")
    return F.when(F.coalesce(F.trim("text"), F.lit("")) == "", -1.0).otherwise(F.col("confidence") - F.when(short, 0.2).otherwise(0.0))


def region(kind: Column) -> Column:
    k = F.lower(kind)
    return F.when(k.isin("table", "table_row"), "table").when(k == "formula", "formula").when(k.isin("figure", "image"), "figure").when(k.isin("reference", "references"), "references").otherwise("text")


def fused(candidates: DataFrame, least_overlap: float = 0.25, least_text: float = 0.82) -> DataFrame:
    """The best candidate of each cluster of one page and region class, in reading order.

    Two candidates of different backends are one region if their boxes overlap or
    their texts agree. Clustering is greedy from the best score down, within the
    candidates of a page and class, which is the unit of work.
    """
    scored = candidates.withColumn("score", candidate_score()).withColumn("region", region(F.col("kind"))).where("score >= 0")
    tokens = scored.withColumn("tokens", F.array_distinct(plain_tokens(F.col("text"))))
    fields = ["page", "region", "candidate_id", "backend", "kind", "text", "bbox", "score"]
    schema = "page int, region string, candidate_id string, backend string, kind string, text string, x0 double, y0 double, x1 double, y1 double, score double, members int"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "candidate_id"], ascending=[False, True])
        kept: list[dict] = []
        for r in pdf.to_dict("records"):
            for k in kept:
                if _same(r, k, least_overlap, least_text):
                    k["members"] += 1
                    break
            else:
                kept.append({**r, "members": 1})
        rows = [{**{c: k[c] for c in k if c in schema.replace(",", "").split()[::2] and c not in ("x0", "y0", "x1", "y1")}, **{c: (k["bbox"] or {}).get(c) if k["bbox"] is not None else None for c in ("x0", "y0", "x1", "y1")}} for k in kept]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    if "paper_version_id" in candidates.columns:  # pages of several documents stay apart
        fields, schema = ["paper_version_id", *fields], "paper_version_id string, " + schema
        return tokens.select(*fields, "tokens").groupBy("paper_version_id", "page", "region").applyInPandas(run, schema)
    return tokens.select(*fields, "tokens").groupBy("page", "region").applyInPandas(run, schema)


def _same(a: dict, b: dict, least_overlap: float, least_text: float) -> bool:
    p, q = a["bbox"], b["bbox"]
    if p is not None and q is not None:
        w = max(0.0, min(p["x1"], q["x1"]) - max(p["x0"], q["x0"]))
        h = max(0.0, min(p["y1"], q["y1"]) - max(p["y0"], q["y0"]))
        union = (p["x1"] - p["x0"]) * (p["y1"] - p["y0"]) + (q["x1"] - q["x0"]) * (q["y1"] - q["y0"]) - w * h
        if w * h / max(1.0, union) >= least_overlap:
            return True
    s, t = set(a["tokens"]), set(b["tokens"])
    return bool(s | t) and len(s & t) / len(s | t) >= least_text


def page_choice(primary: DataFrame, alternate: DataFrame) -> DataFrame:
    """(page, chosen): per page the alternate parse only where it is strictly better and has text.

    Both inputs are (page, verdict, chars); GOOD beats SUSPECT beats LOW, and a page
    the primary lacks takes the alternate.
    """
    rank = lambda v: F.when(v == "GOOD", 2).when(v == "SUSPECT", 1).when(v == "LOW", 0)
    p = primary.select("page", rank(F.col("verdict")).alias("p"))
    a = alternate.select("page", rank(F.col("verdict")).alias("a"), F.col("chars").alias("a_chars"))
    both = p.join(a, "page", "full_outer")
    better = (F.coalesce("a_chars", F.lit(0)) > 0) & (F.col("p").isNull() | (F.col("a") > F.col("p")))
    return both.select("page", F.when(F.coalesce(better, F.lit(False)), "alternate").otherwise("primary").alias("chosen"))


def repair_targets(pages: DataFrame, attempted: DataFrame, backend: str, budget: int = 20) -> DataFrame:
    """The first ``budget`` weak pages that this backend has not been tried on."""
    weak = pages.where("verdict in ('LOW', 'SUSPECT')")
    return weak.join(attempted.where(F.col("backend") == backend).select("page"), "page", "left_anti").orderBy("page").limit(budget)


def inside(points: DataFrame, boxes: DataFrame, margin: float = 1.0) -> DataFrame:
    """Marks rows whose box lies within a box of the same version and page."""
    key = ["paper_version_id", "page"]
    near = points.join(boxes.select(*key, F.col("bbox").alias("outer")), key)
    inner, outer = F.col("bbox"), F.col("outer")
    fits = (inner["x0"] >= outer["x0"] - margin) & (inner["x1"] <= outer["x1"] + margin) & (inner["y0"] >= outer["y0"] - margin) & (inner["y1"] <= outer["y1"] + margin)
    hit = near.where(fits).select("block_id").distinct().withColumn("is_inside", F.lit(True))
    return points.join(hit, "block_id", "left").withColumn("is_inside", F.coalesce("is_inside", F.lit(False)))


def text_ratio(a: Column, b: Column) -> Column:
    """Token agreement of two texts."""
    return jaccard(F.array_distinct(plain_tokens(a)), F.array_distinct(plain_tokens(b)))
