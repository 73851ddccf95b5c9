"""Reading order, sections, paragraphs and chunks as ordered operations on DataFrames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions.text import dehyphenate, match_form, token_estimate

# Canonical section names and the headings that stand for them.
SECTION_NAMES = {
    "abstract": ["abstract", "summary", "摘要"],
    "introduction": ["introduction", "motivation", "引言", "绪论"],
    "background": ["background", "preliminaries", "背景", "预备知识"],
    "related_work": ["related work", "literature review", "相关工作", "文献综述"],
    "method": ["method", "methods", "methodology", "approach", "model", "方法", "方法论"],
    "experiments": ["experiment", "experiments", "experimental setup", "evaluation", "实验", "评估"],
    "results": ["result", "results", "findings", "结果"],
    "discussion": ["discussion", "analysis", "讨论", "分析"],
    "limitations": ["limitation", "limitations", "局限", "局限性"],
    "conclusion": ["conclusion", "conclusions", "concluding remarks", "final remarks", "结论"],
    "references": ["reference", "references", "bibliography", "参考文献"],
    "appendix": ["appendix", "appendices", "supplementary material", "附录"],
    "acknowledgements": ["acknowledgement", "acknowledgements", "acknowledgment", "acknowledgments", "致谢"],
}
SECTION_PATTERNS = [
    (r"(?:^|\s)ablation", "experiments"), (r"(?:^|\s)benchmark", "experiments"), ("real robot", "experiments"),
    (r"(?:^|\s)implementation details", "method"), ("problem formulation", "method"), (r"fine[- ]?tuning", "method"),
    (r"meta[- ]?learning", "method"), (r"^algorithms?\s+for", "method"), ("main results", "results"),
]
NUMBERING = r"(?i)^\s*(?:section\s+)?(?:[0-9]+(?:\.[0-9]+){0,3}|[ivxlcdm]+|[A-Z])[.)]?\s+"


def canonical_section(title: Column) -> Column:
    """Section kind of a heading: exact name, then last word of a short heading, then a pattern, else null."""
    name = match_form(F.regexp_replace(title, NUMBERING, ""))
    words = F.split(name, " ")
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(SECTION_PATTERNS):
        out = F.when(name.rlike(pattern), kind).otherwise(out)
    for kind, names in reversed(SECTION_NAMES.items()):
        out = F.when((F.size(words) <= 5) & F.element_at(words, -1).isin(names), kind).otherwise(out)
    for kind, names in reversed(SECTION_NAMES.items()):
        out = F.when(name.isin(names), kind).otherwise(out)
    return out


def heading_level(title: Column) -> Column:
    """Depth of a numbered heading, at most 4; 1 without a number."""
    number = F.regexp_extract(title, r"^\s*([0-9]+(?:\.[0-9]+){0,3})", 1)
    return F.least(F.lit(4), F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)


def section_ends(sections: DataFrame) -> DataFrame:
    """Each section's last page: the one before the next section starts, at least its own first page."""
    order = W.partitionBy("paper_version_id").orderBy(F.col("start_page").asc_nulls_last(), "section_id")
    nxt = F.lead("start_page").over(order)
    return sections.withColumn("last_page", F.when(nxt.isNull(), F.coalesce("end_page", "start_page")).otherwise(F.greatest("start_page", nxt - 1)))


def fill_forward(blocks: DataFrame) -> DataFrame:
    """The heading each block stands under: the last HEADING at or before it in reading order."""
    order = W.partitionBy("paper_version_id").orderBy("page", "block_index", "block_id")
    heading = F.when(F.col("block_type") == "HEADING", F.col("text"))
    return blocks.withColumn("under", F.last(heading, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))


def paragraph_islands(blocks: DataFrame) -> DataFrame:
    """Number of the paragraph each block belongs to.

    A paragraph ends at a page, section or type change, at a gap over 0.85 of the
    body size, or at a sentence end before a gap over 0.35 of it.
    """
    order = W.partitionBy("paper_version_id").orderBy("page", "block_index", "block_id")
    nxt = lambda c: F.lead(c).over(order)
    size = F.coalesce(F.nullif(F.col("metadata")["body_font_size"].try_cast("double"), F.lit(0.0)), F.nullif("font_size", F.lit(0.0)), F.lit(10.0))
    gap = nxt(F.col("bbox.y0")) - F.col("bbox.y1")
    ends = (
        nxt("block_id").isNull()
        | (nxt("page") != F.col("page"))
        | ~nxt("section_id").eqNullSafe(F.col("section_id"))
        | (F.col("block_type") != "TEXT")
        | (nxt("block_type") != "TEXT")
        | (gap > size * 0.85)
        | (F.col("text").rlike(r"[.!?。！？][\])\"'’”]*$") & (gap > size * 0.35))
    )
    marked = blocks.withColumn("_ends", F.coalesce(ends, F.lit(False)).cast("int"))
    before = F.sum("_ends").over(order.rowsBetween(W.unboundedPreceding, -1))
    return marked.withColumn("paragraph", F.coalesce(before, F.lit(0))).drop("_ends")


def pack(sizes: pd.DataFrame, target: int, most: int) -> list[int]:
    """Greedy chunk number of each paragraph in order: flush before overflow or a new section, after the target."""
    out, chunk, total, section, first = [], 0, 0, None, True
    for tokens, sec in zip(sizes["tokens"], sizes["section_id"]):
        same = sec == section or (sec != sec and section != section) or (sec is None and section is None)
        if not first and total and (not same or total + tokens > most):
            chunk, total = chunk + 1, 0
        out.append(chunk)
        total += tokens
        section, first = sec, False
        if total >= target:
            chunk, total = chunk + 1, 0
    return out


def chunk_packing(paragraphs: DataFrame, target: int = 420, most: int = 650) -> DataFrame:
    """(paper_version_id, section_id, paragraph, tokens, chunk): paragraphs packed into chunks.

    The packing restarts at every section, so a section is the unit of work and a
    long version never sits in one task.
    """
    schema = "paper_version_id string, section_id string, paragraph long, tokens int, chunk int"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("paragraph")
        return pdf.assign(chunk=pack(pdf, target, most))[["paper_version_id", "section_id", "paragraph", "tokens", "chunk"]]

    return paragraphs.select("paper_version_id", "section_id", "paragraph", "tokens").groupBy("paper_version_id", "section_id").applyInPandas(run, schema)


def paragraph_texts(blocks: DataFrame) -> DataFrame:
    """(paper_version_id, section_id, paragraph, text, tokens, blocks): joined, de-hyphenated paragraphs."""
    marked = paragraph_islands(blocks)
    parts = F.array_sort(F.collect_list(F.struct("page", "block_index", "block_id", "text")))
    rows = marked.groupBy("paper_version_id", "section_id", "paragraph").agg(parts.alias("parts"))
    text = dehyphenate(F.array_join("parts.text", " "))
    return rows.select("paper_version_id", "section_id", "paragraph", text.alias("text"), token_estimate(text).alias("tokens"), F.size("parts").alias("blocks"))


def table_runs(blocks: DataFrame) -> DataFrame:
    """(paper_version_id, page, first_index, last_index, rows, caption): runs of TABLE_ROW blocks as one table.

    The caption is the first CAPTION among the places after, before, two after, two before the run.
    """
    rows = blocks.where("block_type = 'TABLE_ROW'").select("paper_version_id", "page", "block_index").distinct()
    order = W.partitionBy("paper_version_id", "page").orderBy("block_index")
    runs = rows.withColumn("run", F.col("block_index") - F.row_number().over(order)).groupBy("paper_version_id", "page", "run").agg(
        F.min("block_index").alias("first_index"), F.max("block_index").alias("last_index"), F.count("*").alias("rows")
    )
    captions = blocks.where("block_type = 'CAPTION'").groupBy("paper_version_id", "page", F.col("block_index").alias("at")).agg(F.min("text").alias("caption"))
    places = runs.select("*", F.explode(F.map_from_arrays(F.array(*[F.lit(i) for i in range(4)]), F.array(
        F.col("last_index") + 1, F.col("first_index") - 1, F.col("last_index") + 2, F.col("first_index") - 2))).alias("order", "at"))
    near = places.join(captions, ["paper_version_id", "page", "at"]).groupBy("paper_version_id", "page", "run").agg(F.min_by("caption", "order").alias("caption"))
    return runs.join(near, ["paper_version_id", "page", "run"], "left").drop("run")


def cell_like(text: Column) -> Column:
    """Short text of which at least 60 % of the tokens are numbers."""
    tokens = F.regexp_extract_all(F.trim(text), F.lit(r"(\S+)"), 1)
    numeric = F.filter(tokens, lambda t: t.rlike(r"^[±\-–—]?[0-9]+(?:\.[0-9]+)?%?$"))
    return F.coalesce((F.length(F.trim(text)) <= 40) & (F.size(tokens) > 0) & (F.size(numeric) >= 0.6 * F.size(tokens)), F.lit(False))


def row_like(text: Column) -> Column:
    """Text with three numbers in a row."""
    return text.rlike(r"(?:^|\s)[±+\-–—]?[0-9]+(?:\.[0-9]+)?%?(?:\s+[±+\-–—]?[0-9]+(?:\.[0-9]+)?%?){2,}(?:\s|$)")


def page_gate(blocks: DataFrame) -> DataFrame:
    """(paper_version_id, page, blocks, tiny_ratio, single_ratio, contaminated, inversions, chars, verdict).

    LOW for tiny blocks over 3 %, numeric cells in the body, reading-order
    inversions over max(1, 2 %) or fewer than 150 characters; SUSPECT for single
    characters over 3 %; pages from the first to the version's last without text
    blocks are GOOD.
    """
    body = blocks.where((F.col("block_type") == "TEXT") & (F.trim("text") != ""))
    order = W.partitionBy("paper_version_id", "page").orderBy("block_index", "block_id")
    up = (F.abs(F.col("bbox.x0") - F.lag("bbox.x0").over(order)) <= 15) & (F.col("bbox.y0") < F.lag("bbox.y0").over(order) - 2)
    marked = body.select(
        "paper_version_id", "page", F.length(F.trim("text")).alias("n"), F.length("text").alias("chars"),
        cell_like(F.col("text")).alias("cell"), F.coalesce(up, F.lit(False)).alias("up"),
    )
    by = marked.groupBy("paper_version_id", "page").agg(
        F.count("*").alias("blocks"), F.count_if(F.col("n") <= 2).alias("tiny"), F.count_if(F.col("n") == 1).alias("single"),
        F.count_if("cell").alias("contaminated"), F.count_if("up").alias("inversions"), F.sum("chars").alias("chars"),
    )
    low = (F.col("tiny") / F.col("blocks") > 0.03) | (F.col("contaminated") > 0) | (F.col("inversions") > F.greatest(F.lit(1), F.floor(F.col("blocks") * 0.02))) | (F.col("chars") < 150)
    verdict = F.when(low, "LOW").when(F.col("single") / F.col("blocks") > 0.03, "SUSPECT").otherwise("GOOD")
    last = blocks.groupBy("paper_version_id").agg(F.max("page").alias("last")).where("last >= 1")
    pages = last.select("paper_version_id", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("page"))
    scored = by.withColumn("verdict", verdict)
    none = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return pages.join(scored, ["paper_version_id", "page"], "left").select(
        "paper_version_id", "page", none("blocks"), F.coalesce(F.round(F.col("tiny") / F.col("blocks"), 4), F.lit(0.0)).alias("tiny_ratio"),
        F.coalesce(F.round(F.col("single") / F.col("blocks"), 4), F.lit(0.0)).alias("single_ratio"), none("contaminated"), none("inversions"), none("chars"),
        F.coalesce("verdict", F.lit("GOOD")).alias("verdict"),
    )


def quality_report(blocks: DataFrame) -> DataFrame:
    """(paper_version_id, pages, coverage, fragment_ratio, inversions, issues, verdict) over whole versions."""
    order = W.partitionBy("paper_version_id", "page").orderBy("block_index", "block_id")
    words = F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"), 1))
    tiny = (words < 4) & (F.length("text") < 16)
    up = F.col("bbox.y0") < F.lag("bbox.y0").over(order) - 1
    pages = blocks.where("block_type = 'TEXT'").select("paper_version_id", "page", F.length("text").alias("chars"), tiny.alias("tiny"), F.coalesce(up, F.lit(False)).alias("up"))
    by_page = pages.groupBy("paper_version_id", "page").agg(F.sum("chars").alias("chars"), F.count("*").alias("n"), F.count_if("tiny").alias("tiny"), F.count_if("up").alias("up"))
    by = by_page.groupBy("paper_version_id").agg(
        F.count("*").alias("pages"), F.round(F.avg(F.least(F.lit(1.0), F.col("chars") / 2200)), 4).alias("coverage"),
        F.round(F.sum("tiny") / F.sum("n"), 4).alias("fragment_ratio"), F.sum("up").alias("inversions"),
    )
    issues = (F.col("coverage") < 0.4).cast("int") + (F.col("fragment_ratio") > 0.1).cast("int") + (F.col("inversions") > F.col("pages")).cast("int")
    return by.withColumn("issues", issues).withColumn("verdict", F.when(issues >= 2, "LOW").when(issues == 1, "SUSPECT").otherwise("GOOD"))


def repeated_margins(blocks: DataFrame) -> DataFrame:
    """(paper_version_id, line, pages): short texts on at least max(2, 60 % of the pages) of a version."""
    total = blocks.groupBy("paper_version_id").agg(F.count_distinct("page").alias("all_pages"))
    line = F.trim(F.regexp_replace(F.lower("text"), r"[0-9]+", "#"))
    seen = blocks.where("length(text) <= 60 and block_type = 'TEXT'").groupBy("paper_version_id", line.alias("line")).agg(F.count_distinct("page").alias("pages"))
    both = seen.join(total, "paper_version_id").where(F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("all_pages") * 0.6)))
    return both.select("paper_version_id", "line", "pages")


def batches(blocks: DataFrame, size: int = 6) -> DataFrame:
    """(block_id, batch, before, after): batches of ``size`` long text blocks with two blocks before and one after as context."""
    order = W.partitionBy("paper_version_id").orderBy("page", "block_index", "block_id")
    own = blocks.where("block_type = 'TEXT' and length(text) > 40")
    numbered = own.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int"))
    return numbered.select("block_id", "batch", F.lag("block_id", 2).over(order).alias("before_two"), F.lag("block_id").over(order).alias("before"), F.lead("block_id").over(order).alias("after"))


def briefs(blocks: DataFrame) -> DataFrame:
    """(section_id, brief): first text of each section, at most 300 characters, after its path."""
    texts = blocks.where("block_type = 'TEXT' and section_id is not null")
    first = texts.groupBy("section_id").agg(F.min_by(F.struct("section_path", "text"), F.struct("page", "block_index", "block_id")).alias("f"))
    return first.select("section_id", F.left(F.concat_ws(" — ", F.nullif("f.section_path", F.lit("")), F.col("f.text")), F.lit(300)).alias("brief"))


def layout(blocks: DataFrame) -> DataFrame:
    """(paper_version_id, body_size, bold_share, columns): layout fingerprint; ties of the mode go to the smaller size."""
    sizes = blocks.where("font_size is not null").groupBy("paper_version_id", F.round("font_size", 1).alias("size")).agg(F.count("*").alias("n"))
    body = sizes.groupBy("paper_version_id").agg(F.max_by("size", F.struct("n", (-F.col("size")).alias("s"))).alias("body_size"))
    share = blocks.groupBy("paper_version_id").agg(
        F.round(F.avg(F.coalesce(F.col("is_bold").cast("double"), F.lit(0.0))), 4).alias("bold_share"), F.count_distinct(F.round(F.col("bbox.x0") / 20)).alias("columns")
    )
    return share.join(body, "paper_version_id", "left")
