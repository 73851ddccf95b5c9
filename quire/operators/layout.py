"""Line, column and page signs of blocks, and projections between the table forms of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions.text import casefold, match_form
from quire.operators.structure import row_like

# Symbols that make a line a formula.
FORMULA_SYMBOLS = r"[=∑∏∫√±×÷≤≥≈∞α-ωΑ-Ω_^{}|]"
# Block types of the second form for those of the first; others are text.
LEGACY_TYPES = {"TABLE": "TABLE_ROW", "FIGURE": "UNKNOWN_MEDIA"}


def valid_pdf(files: DataFrame, max_mb: int = 80) -> DataFrame:
    """Adds ``problem`` to binary files (path, content): EMPTY, TOO_LARGE, NOT_PDF or null. Null content is empty."""
    size = F.coalesce(F.octet_length("content"), F.lit(0))
    head = F.decode(F.substring("content", 1, 5), "ISO-8859-1")
    return files.withColumn("problem", F.when(size == 0, "EMPTY").when(size > max_mb << 20, "TOO_LARGE").when(head != "%PDF-", "NOT_PDF"))


def formula_like(text: Column) -> Column:
    """Five to 240 characters with at least two mathematical symbols, a fifth of all, and at most three words; null is false."""
    symbols, words = F.regexp_count(text, F.lit(FORMULA_SYMBOLS)), F.regexp_count(text, F.lit(r"[A-Za-z]{3,}"))
    return F.coalesce(F.length(text).between(5, 240) & (symbols >= 2) & (symbols * 5 >= F.length(text)) & (words <= 3), F.lit(False))


def author_block(text: Column) -> Column:
    """A list of names: at most 200 characters, 65 % of the words capitalised, with a comma, ``and`` or capitals throughout."""
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z]+)"), 1)
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^[A-Z]")))
    listed = text.rlike(r"\sand\s") | text.contains(",") | (capital == F.size(words))
    return F.coalesce((F.length(text) <= 200) & (F.size(words) > 0) & (capital >= 0.65 * F.size(words)) & listed, F.lit(False))


def block_type_of(kind: Column) -> Column:
    """The block type of the second form: mapped, kept if known, TEXT where null or empty."""
    mapped = F.create_map(*[F.lit(x) for kv in LEGACY_TYPES.items() for x in kv])[kind]
    return F.coalesce(mapped, F.when(kind != "", kind), F.lit("TEXT"))


def legacy_blocks(blocks: DataFrame) -> DataFrame:
    """The second form of blocks: types mapped, section path and order left out."""
    return blocks.select("block_id", "paper_version_id", "page", block_type_of(F.col("block_type")).alias("block_type"), "text", "section_id")


def nodes(blocks: DataFrame) -> DataFrame:
    """Canonical nodes (node_id, revision_id, source_version_id, node_type, parent_id, order_index, page, text, content_hash) of blocks.

    The node is the block's place, the revision its content: equal text keeps the revision. The parent is the section.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return blocks.select(
        F.concat(F.lit("node-"), "block_id").alias("node_id"), F.concat(F.lit("rev-"), F.left(F.sha2(F.concat_ws("|", "block_id", digest), 256), F.lit(16))).alias("revision_id"),
        F.col("paper_version_id").alias("source_version_id"), block_type_of(F.col("block_type")).alias("node_type"), F.col("section_id").alias("parent_id"),
        F.col("block_index").alias("order_index"), "page", "text", digest.alias("content_hash"),
    )


def blocks_of(node_rows: DataFrame) -> DataFrame:
    """Back from nodes to blocks; the inverse of :func:`nodes` on id, version, page, order, section and text."""
    return node_rows.select(F.regexp_replace("node_id", "^node-", "").alias("block_id"), F.col("source_version_id").alias("paper_version_id"), "page", F.col("order_index").alias("block_index"), F.col("parent_id").alias("section_id"), "text")


def body_font(blocks: DataFrame) -> DataFrame:
    """(paper_version_id, median_font, upper_width): median font size, and the upper median of the widths of at least 50 points."""
    width = F.col("bbox.x1") - F.col("bbox.x0")
    wide = F.array_sort(F.collect_list(F.when(width >= 50, width)))
    body = blocks.where("block_type = 'TEXT'").groupBy("paper_version_id", "page").agg(F.array_sort(F.collect_list("font_size")).alias("f"), wide.alias("w"))
    by = body.groupBy("paper_version_id").agg(F.array_sort(F.flatten(F.collect_list("f"))).alias("f"), F.array_sort(F.flatten(F.collect_list("w"))).alias("w"))
    n, m = F.size("f"), F.size("w")
    middle = (F.get("f", F.floor((n - 1) / 2).cast("int")) + F.get("f", F.floor(n / 2).cast("int"))) / 2
    return by.select("paper_version_id", F.round(middle, 4).alias("median_font"), F.round(F.get("w", F.floor(m / 2).cast("int")), 4).alias("upper_width"))


def standalone_line(blocks: DataFrame, body_size: float = 10.0, median_width: float = 400.0) -> DataFrame:
    """Adds ``standalone``: empty text, captions, table rows, page numbers, and lines of up to eight words that are numbered, larger, or bold and narrow."""
    text = F.trim(F.coalesce("text", F.lit("")))
    few = F.size(F.split(text, r"\s+")) <= 8
    width = F.col("bbox.x1") - F.col("bbox.x0")
    larger = F.coalesce(F.col("font_size") >= max(body_size * 1.08, 8.5), F.lit(False))
    bold = F.coalesce(F.col("is_bold"), F.lit(False)) & F.coalesce(width < median_width * 0.65, F.lit(False))
    numbered = text.rlike(r"^[0-9]+(\.[0-9]+)*[.)]?\s+[A-Z]")
    caption = text.rlike(r"(?i)^(figure|fig\.|table|algorithm)\s*[0-9]+")
    return blocks.withColumn("standalone", (text == "") | caption | row_like(text) | text.rlike(r"^[0-9]{1,4}$") | (few & (numbered | larger | bold)))


def column_thresholds(blocks: DataFrame, page_width: float = 612.0) -> DataFrame:
    """(paper_version_id, page, threshold): the middle of the widest gap between left edges, if over 5 % of the width and 30 points.

    Of fragments 50 points wide at least and up to 55 % of the page; pages with under four have none. Ties go to the leftmost gap.
    """
    width = F.col("bbox.x1") - F.col("bbox.x0")
    wide = blocks.where((width <= page_width * 0.55) & (width >= 50)).select("paper_version_id", "page", F.col("bbox.x0").alias("x"))
    nxt = F.lead("x").over(W.partitionBy("paper_version_id", "page").orderBy("x"))
    gaps = wide.withColumn("next", nxt).withColumn("gap", F.col("next") - F.col("x"))
    best = gaps.groupBy("paper_version_id", "page").agg(F.count("*").alias("n"), F.max_by(F.struct("x", "next", "gap"), F.struct("gap", -F.col("x"))).alias("b")).where("n >= 4")
    return best.where(F.col("b.gap") > max(page_width * 0.05, 30.0)).select("paper_version_id", "page", F.round((F.col("b.x") + F.col("b.next")) / 2, 4).alias("threshold"))


def largest_title(blocks: DataFrame, least: float = 0.92, most_lines: int = 3) -> DataFrame:
    """(paper_version_id, title): the lines of page 1 set at 92 % of its largest size or more, the first three in reading order."""
    first = blocks.where("page = 1 and font_size is not null and trim(text) != ''").select("paper_version_id", "block_index", "block_id", "text", "font_size")
    top = first.groupBy("paper_version_id").agg(F.max("font_size").alias("top"))
    big = first.join(top, "paper_version_id").where(F.col("font_size") >= F.col("top") * least)
    by = big.groupBy("paper_version_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("block_index", "block_id", "text"))), 1, most_lines).alias("l"))
    return by.select("paper_version_id", F.array_join(F.transform("l", lambda x: F.trim(x["text"])), " ").alias("title"))


def inherited_kinds(sections: DataFrame) -> DataFrame:
    """(section_id, kind): a section's own kind, else that of the nearest known section above it by its parents.

    One join per level of the hierarchy, bounded by the four levels a heading has.
    """
    out = sections.select("section_id", "parent_id", F.col("canonical_name").alias("kind"))
    above = out.select(F.col("section_id").alias("up"), F.col("parent_id").alias("next"), F.col("kind").alias("theirs"))
    for _ in range(4):
        out = out.join(above, out["parent_id"] == above["up"], "left").select("section_id", F.when(F.col("kind").isNull(), F.col("next")).otherwise(F.col("parent_id")).alias("parent_id"), F.coalesce("kind", "theirs").alias("kind"))
    return out.select("section_id", "kind")


def ancestor_paths(sections: DataFrame) -> DataFrame:
    """(section_id, path): the titles from the root down, joined by `` > ``; missing parents end the path."""
    out = sections.select("section_id", "parent_id", F.coalesce("title", F.lit("")).alias("path"))
    above = sections.select(F.col("section_id").alias("up"), F.col("parent_id").alias("next"), F.coalesce("title", F.lit("")).alias("theirs"))
    for _ in range(4):
        out = out.join(above, out["parent_id"] == above["up"], "left").select("section_id", F.col("next").alias("parent_id"), F.when(F.col("theirs").isNull(), F.col("path")).otherwise(F.concat_ws(" > ", "theirs", "path")).alias("path"))
    return out.select("section_id", "path")


def outside_references(sections: DataFrame) -> DataFrame:
    """The sections but the nameless ones that begin within the pages of their version's reference list."""
    spans = sections.where("canonical_name = 'references'").groupBy("paper_version_id").agg(F.min("start_page").alias("from_"), F.max(F.coalesce("end_page", "start_page")).alias("to_"))
    inside = (F.col("start_page") >= F.col("from_")) & (F.col("start_page") <= F.col("to_")) & F.col("canonical_name").isNull()
    return sections.join(spans, "paper_version_id", "left").where(~F.coalesce(inside, F.lit(False))).select(*sections.columns)


def outside_media(headings: DataFrame, media: DataFrame) -> DataFrame:
    """The headings whose middle lies in no box of the media of their page."""
    box = media.select(F.col("paper_version_id").alias("v"), F.col("page").alias("p"), F.col("bbox").alias("m"))
    cx, cy = (F.col("bbox.x0") + F.col("bbox.x1")) / 2, (F.col("bbox.y0") + F.col("bbox.y1")) / 2
    within = (F.col("paper_version_id") == F.col("v")) & (F.col("page") == F.col("p")) & (cx >= F.col("m.x0")) & (cx <= F.col("m.x1")) & (cy >= F.col("m.y0")) & (cy <= F.col("m.y1"))
    return headings.join(box, within, "left_anti")


def before_references(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """The blocks on pages strictly before their version's reference list; versions without one keep all."""
    first = sections.where("canonical_name = 'references'").groupBy("paper_version_id").agg(F.min("start_page").alias("ref_page"))
    return blocks.join(first, "paper_version_id", "left").where(F.col("ref_page").isNull() | (F.col("page") < F.col("ref_page"))).drop("ref_page")


def formula_context(blocks: DataFrame) -> DataFrame:
    """(block_id, number, before, after): of FORMULA blocks the trailing ``(n)`` and 150 characters of the text beside, on the page."""
    order = W.partitionBy("paper_version_id", "page").orderBy("block_index", "block_id")
    text = F.when(F.col("block_type") == "TEXT", F.left("text", F.lit(150)))
    seen = blocks.withColumn("before", F.last(text, True).over(order.rowsBetween(W.unboundedPreceding, -1))).withColumn("after", F.first(text, True).over(order.rowsBetween(1, W.unboundedFollowing)))
    number = F.regexp_extract("text", r"\(([0-9]+)\)\s*$", 1)
    return seen.where("block_type = 'FORMULA'").select("block_id", F.when(number != "", number).alias("number"), "before", "after")


def media_ranks(blocks: DataFrame, kinds: list[str]) -> DataFrame:
    """(block_id, rank): the place of media by their upper edge among all blocks of the page, from 1; ties by id."""
    place = F.row_number().over(W.partitionBy("paper_version_id", "page").orderBy("bbox.y0", "block_id"))
    return blocks.withColumn("rank", place).where(F.col("block_type").isin(kinds)).select("block_id", "rank")


def section_texts(blocks: DataFrame) -> DataFrame:
    """(section_id, text): the texts of a section's TEXT blocks in reading order, a line each."""
    body = blocks.where("block_type = 'TEXT' and section_id is not null and text is not null")
    by = body.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("page", "block_index", "block_id", "text"))).alias("l"))
    return by.select("section_id", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))


def heading_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(paper_version_id, precision, recall, f1) of predicted against gold headings, each (paper_version_id, title, page), by normal title and page."""
    form = lambda df, name: df.select("paper_version_id", match_form(F.coalesce("title", F.lit(""))).alias("title"), "page").distinct().withColumn(name, F.lit(1))
    both = form(predicted, "p").join(form(gold, "g"), ["paper_version_id", "title", "page"], "full")
    by = both.groupBy("paper_version_id").agg(F.sum(F.col("p") * F.col("g")).alias("hit"), F.sum("p").alias("p"), F.sum("g").alias("g")).fillna(0)
    ratio = lambda of: F.round(F.coalesce(F.try_divide("hit", of), F.lit(0.0)), 6)
    return by.select("paper_version_id", ratio(F.col("p")).alias("precision"), ratio(F.col("g")).alias("recall"), ratio((F.col("p") + F.col("g")) / 2).alias("f1"))


def same_unit(source: Column, text: Column) -> Column:
    """Whether a translation unit still is its block: the first 80 characters without white space and ``$`` agree and are not empty."""
    form = lambda c: F.left(F.regexp_replace(c, r"[\s$]+", ""), F.lit(80))
    return F.coalesce((form(source) != "") & (form(source) == form(text)), F.lit(False))


def safe_name(name: Column) -> Column:
    """The last part of a path with anything but letters, digits, ``.``, ``_`` and ``-`` as ``_``; ``paper.pdf`` where nothing is left."""
    base = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"[^A-Za-z0-9._-]+", "_")
    return F.coalesce(F.when(base != "", base), F.lit("paper.pdf"))


def first_sentence(text: Column, limit: int = 200) -> Column:
    """Up to the first closing mark before white space, else the first ``limit`` characters; empty for null."""
    t = F.trim(F.coalesce(text, F.lit("")))
    first = F.regexp_extract(t, r"(?s)^(.*?[.!?。！？])\s", 1)
    return F.when(first != "", first).otherwise(F.trim(F.left(t, F.lit(limit))))


def numeric_result(value: Column) -> Column:
    """A result written as text as a number; a percent sign is dropped, what is no number gives null."""
    return F.trim(F.replace(value, F.lit("%"), F.lit(""))).try_cast("double")


def chinese_digits(text: Column) -> Column:
    """Single Chinese numerals as digits; both forms of two are 2."""
    return F.translate(text, "零一二两三四五六七八九", "01223456789")


def surname(name: Column) -> Column:
    """The folded surname: the last word before a comma, else the last word; empty where there is none."""
    plain = F.trim(F.regexp_replace(casefold(F.when(name.contains(","), F.substring_index(name, ",", 1)).otherwise(name)), r"[^a-z0-9]+", " "))
    return F.coalesce(F.element_at(F.split(plain, " "), -1), F.lit(""))
