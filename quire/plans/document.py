"""Queries on sections, blocks and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import structure as S
from quire.sources.tables import latest, table

_ONE = "(SELECT DISTINCT ON (block_id) * FROM blocks ORDER BY block_id, ingested_at DESC NULLS LAST)"
_NEED = ["block_id", "paper_version_id", "page", "block_index", "block_type", "text", "bbox", "font_size", "is_bold", "section_id", "section_path", "ingested_at"]


def blocks(spark, root, *more):
    return latest(table(spark, root, "blocks", *_NEED, *more), "block_id")


def one_sections(spark, root):
    return table(spark, root, "sections").dropDuplicates(["section_id"])


def _alias_sql() -> str:
    name = r"trim(regexp_replace(replace(lower(regexp_replace(title, '^\s*(?:section\s+)?(?:[0-9]+(?:\.[0-9]+){0,3}|[ivxlcdm]+|[A-Z])[.)]?\s+', '', 'i')), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g'))"
    quoted = lambda names: ", ".join(f"'{n}'" for n in names)
    exact = " ".join(f"WHEN name IN ({quoted(v)}) THEN '{k}'" for k, v in S.SECTION_NAMES.items())
    last = " ".join(f"WHEN len(words) <= 5 AND words[-1] IN ({quoted(v)}) THEN '{k}'" for k, v in S.SECTION_NAMES.items())
    pats = " ".join(f"WHEN regexp_matches(name, '{p}') THEN '{k}'" for p, k in S.SECTION_PATTERNS)
    return f"""SELECT section_id, CASE {exact} {last} {pats} END AS kind,
      least(4, length(number) - length(replace(number, '.', '')) + 1) AS level_
    FROM (SELECT section_id, {name} AS name, string_split({name}, ' ') AS words, regexp_extract(raw_title, '^\\s*([0-9]+(?:\\.[0-9]+){{0,3}})', 1) AS number, raw_title
      FROM (SELECT DISTINCT ON (section_id) * FROM sections))"""


def section_kinds(spark, root):
    s = one_sections(spark, root)
    return s.select("section_id", S.canonical_section(F.col("title")).alias("kind"), S.heading_level(F.col("raw_title")).alias("level_"))


def section_ends(spark, root):
    return S.section_ends(one_sections(spark, root)).select("section_id", "last_page")


def fill_forward(spark, root):
    return S.fill_forward(blocks(spark, root)).select("block_id", "under")


def paragraph_islands(spark, root):
    return S.paragraph_islands(blocks(spark, root, "metadata")).select("block_id", "paragraph")


def chunk_packing(spark, root):
    return S.chunk_packing(S.paragraph_texts(blocks(spark, root, "metadata"))).groupBy("paper_version_id", "section_id").agg(
        F.count("*").alias("paragraphs"), F.sum("tokens").alias("tokens"), (F.max("chunk") + 1).alias("chunks")
    )


def table_runs(spark, root):
    return S.table_runs(blocks(spark, root))


def page_gate(spark, root):
    return S.page_gate(blocks(spark, root))


def quality_report(spark, root):
    return S.quality_report(blocks(spark, root))


def repeated_margins(spark, root):
    return S.repeated_margins(blocks(spark, root))


def batch_context(spark, root):
    return S.batches(blocks(spark, root))


def section_briefs(spark, root):
    return S.briefs(blocks(spark, root))


def layout_fingerprint(spark, root):
    return S.layout(blocks(spark, root))


def row_predicates(spark, root):
    b = blocks(spark, root)
    return b.select("block_id", S.cell_like(F.col("text")).alias("is_cell"), S.row_like(F.col("text")).alias("is_row"))


def token_estimates(spark, root):
    c = table(spark, root, "chunks", "chunk_id", "text", "token_estimate").dropDuplicates(["chunk_id"])
    n = T.token_estimate(F.col("text"))
    return c.select("chunk_id", n.alias("tokens"), (n - F.col("token_estimate")).alias("drift"))


def match_forms(spark, root):
    return table(spark, root, "documents", "doc_id", "text").select("doc_id", F.sha2(T.match_form(F.col("text")), 256).alias("form_hash"))


def hyphen_repair(spark, root):
    d = table(spark, root, "documents", "doc_id", "text").select("doc_id", F.length(T.dehyphenate(F.col("text"))).alias("chars"))
    return d


def chunk_blocks(spark, root):
    """Blocks of each chunk in their order, with types joined from the blocks table."""
    c = table(spark, root, "chunks", "chunk_id", "block_ids").dropDuplicates(["chunk_id"]).select("chunk_id", F.posexplode("block_ids").alias("pos", "block_id"))
    b = blocks(spark, root).select("block_id", "block_type")
    return c.join(b, "block_id").groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "block_type"))).block_type, ">").alias("types"))


def span_blocks(spark, root):
    """Blocks that the span of characters 100 to 400 of each chunk touches, clipped to the block."""
    c = table(spark, root, "chunks", "chunk_id", "segments").dropDuplicates(["chunk_id"]).select("chunk_id", F.explode("segments").alias("s")).select("chunk_id", "s.*")
    start, end = F.greatest("chunk_char_start", F.lit(100)), F.least("chunk_char_end", F.lit(400))
    hit = c.where(start < end)
    return hit.select("chunk_id", "block_id", (F.col("block_char_start") + start - F.col("chunk_char_start")).alias("from_char"), (F.col("block_char_start") + end - F.col("chunk_char_start")).alias("to_char"))


def caption_nearest(spark, root):
    """For each formula the caption of its page whose centre is nearest by L1 distance."""
    b = blocks(spark, root).select("block_id", "paper_version_id", "page", "block_type", ((F.col("bbox.x0") + F.col("bbox.x1")) / 2).alias("cx"), ((F.col("bbox.y0") + F.col("bbox.y1")) / 2).alias("cy"))
    f, c = b.where("block_type = 'FORMULA'").alias("f"), b.where("block_type = 'CAPTION'").alias("c")
    both = f.join(c, (F.col("f.paper_version_id") == F.col("c.paper_version_id")) & (F.col("f.page") == F.col("c.page")))
    d = F.round(F.abs(F.col("f.cx") - F.col("c.cx")) + F.abs(F.col("f.cy") - F.col("c.cy")), 4)
    best = F.min_by(F.struct(F.col("c.block_id").alias("id"), d.alias("d")), F.struct(d.alias("d"), F.col("c.block_id").alias("id")))
    return both.groupBy(F.col("f.block_id").alias("formula")).agg(best.alias("b")).select("formula", F.col("b.id").alias("caption"), F.col("b.d").alias("distance"))


_ORDER = "PARTITION BY paper_version_id ORDER BY page, block_index, block_id"
_SIZE = "coalesce(nullif(try_cast(metadata['body_font_size'] AS DOUBLE), 0), nullif(font_size, 0), 10)"
_ISLANDS = f"""marked AS (SELECT *, coalesce(lead(block_id) OVER w IS NULL OR lead(page) OVER w != page OR lead(section_id) OVER w IS DISTINCT FROM section_id
      OR block_type != 'TEXT' OR lead(block_type) OVER w != 'TEXT' OR lead(bbox.y0) OVER w - bbox.y1 > {_SIZE} * 0.85
      OR (regexp_matches(text, '[.!?。！？][\\])"''’”]*$') AND lead(bbox.y0) OVER w - bbox.y1 > {_SIZE} * 0.35), false)::INT AS e FROM {_ONE} WINDOW w AS ({_ORDER})),
    islands AS (SELECT *, coalesce(sum(e) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS paragraph FROM marked)"""
_TOKENS = r"greatest(1, len(regexp_extract_all({t}, '[A-Za-z0-9_]+')) + len(regexp_extract_all({t}, '[㐀-鿿]')) + len(regexp_extract_all({t}, '[^\p{{L}}\p{{N}}_\s]')) // 3)"
_JOINED = r"regexp_replace(text, '([A-Za-z])-\s+([a-z])', '\1\2', 'g')"
_CELL = r"coalesce(length(trim(text)) <= 40 AND len(tok) > 0 AND len(list_filter(tok, lambda t: regexp_full_match(t, '[±\-–—]?[0-9]+(?:\.[0-9]+)?%?'))) >= 0.6 * len(tok), false)"
_TOK = r"regexp_extract_all(trim(text), '\S+')"

QUERIES = {f.__name__: f for f in (
    section_kinds, section_ends, fill_forward, paragraph_islands, chunk_packing, table_runs, page_gate, quality_report, repeated_margins,
    batch_context, section_briefs, layout_fingerprint, row_predicates, token_estimates, match_forms, hyphen_repair, chunk_blocks, span_blocks, caption_nearest,
)}
SQL = {
    "section_kinds": _alias_sql(),
    "section_ends": """SELECT section_id, CASE WHEN n IS NULL THEN coalesce(end_page, start_page) ELSE greatest(start_page, n - 1) END AS last_page FROM
      (SELECT *, lead(start_page) OVER (PARTITION BY paper_version_id ORDER BY start_page NULLS LAST, section_id) AS n FROM (SELECT DISTINCT ON (section_id) * FROM sections))""",
    "fill_forward": f"""SELECT block_id, last_value(CASE WHEN block_type = 'HEADING' THEN text END IGNORE NULLS) OVER ({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS under FROM {_ONE}""",
    "paragraph_islands": f"WITH {_ISLANDS} SELECT block_id, paragraph FROM islands",
    "chunk_packing": f"""WITH RECURSIVE {_ISLANDS},
      texts AS (SELECT paper_version_id, section_id, paragraph, string_agg(text, ' ' ORDER BY page, block_index, block_id) AS text FROM islands GROUP BY ALL),
      sized AS (SELECT paper_version_id, section_id, {_TOKENS.format(t=_JOINED)} AS tokens,
        row_number() OVER (PARTITION BY paper_version_id, section_id ORDER BY paragraph) AS k FROM texts),
      packed AS (SELECT paper_version_id, section_id, k, tokens AS total, 0 AS chunk, tokens FROM sized WHERE k = 1
        UNION ALL SELECT s.paper_version_id, s.section_id, s.k,
          CASE WHEN p.total >= 420 OR p.total + s.tokens > 650 THEN s.tokens ELSE p.total + s.tokens END,
          CASE WHEN p.total >= 420 OR p.total + s.tokens > 650 THEN p.chunk + 1 ELSE p.chunk END, s.tokens
        FROM packed p JOIN sized s ON s.paper_version_id = p.paper_version_id AND s.section_id IS NOT DISTINCT FROM p.section_id AND s.k = p.k + 1)
      SELECT paper_version_id, section_id, count(*) AS paragraphs, sum(tokens)::BIGINT AS tokens, max(chunk) + CASE WHEN false THEN 1 ELSE 1 END AS chunks FROM packed GROUP BY ALL""",
    "table_runs": f"""WITH r AS (SELECT DISTINCT paper_version_id, page, block_index FROM {_ONE} WHERE block_type = 'TABLE_ROW'),
      g AS (SELECT *, block_index - row_number() OVER (PARTITION BY paper_version_id, page ORDER BY block_index) AS run FROM r),
      runs AS (SELECT paper_version_id, page, run, min(block_index) AS first_index, max(block_index) AS last_index, count(*) AS rows FROM g GROUP BY ALL),
      cap AS (SELECT paper_version_id, page, block_index AS at, min(text) AS caption FROM {_ONE} WHERE block_type = 'CAPTION' GROUP BY ALL)
      SELECT r.paper_version_id, r.page, first_index, last_index, rows, coalesce(a.caption, b.caption, c.caption, d.caption) AS caption FROM runs r
      LEFT JOIN cap a ON a.paper_version_id = r.paper_version_id AND a.page = r.page AND a.at = last_index + 1
      LEFT JOIN cap b ON b.paper_version_id = r.paper_version_id AND b.page = r.page AND b.at = first_index - 1
      LEFT JOIN cap c ON c.paper_version_id = r.paper_version_id AND c.page = r.page AND c.at = last_index + 2
      LEFT JOIN cap d ON d.paper_version_id = r.paper_version_id AND d.page = r.page AND d.at = first_index - 2""",
    "page_gate": f"""WITH m AS (SELECT paper_version_id, page, length(trim(text)) AS n, length(text) AS chars, {_CELL} AS cell,
        coalesce(abs(bbox.x0 - lag(bbox.x0) OVER w) <= 15 AND bbox.y0 < lag(bbox.y0) OVER w - 2, false) AS up
        FROM (SELECT *, {_TOK} AS tok FROM {_ONE}) WHERE block_type = 'TEXT' AND trim(text) != '' WINDOW w AS (PARTITION BY paper_version_id, page ORDER BY block_index, block_id)),
      g AS (SELECT paper_version_id, page, count(*) AS blocks, count_if(n <= 2) AS tiny, count_if(n = 1) AS single, count_if(cell)::BIGINT AS contaminated,
        count_if(up)::BIGINT AS inversions, sum(chars)::BIGINT AS chars FROM m GROUP BY ALL)
      SELECT paper_version_id, page, coalesce(blocks, 0) AS blocks, coalesce(round(tiny / blocks, 4), 0) AS tiny_ratio, coalesce(round(single / blocks, 4), 0) AS single_ratio,
        coalesce(contaminated, 0) AS contaminated, coalesce(inversions, 0) AS inversions, coalesce(chars, 0) AS chars, CASE WHEN tiny / blocks > 0.03 OR contaminated > 0 OR inversions > greatest(1, floor(blocks * 0.02)) OR chars < 150 THEN 'LOW' WHEN single / blocks > 0.03 THEN 'SUSPECT' ELSE 'GOOD' END AS verdict
        FROM (SELECT paper_version_id, unnest(range(1, last_ + 1))::INT AS page FROM (SELECT paper_version_id, max(page) AS last_ FROM blocks GROUP BY 1)) LEFT JOIN g USING (paper_version_id, page)""",
    "quality_report": rf"""WITH p AS (SELECT paper_version_id, page, length(text) AS chars, len(regexp_extract_all(text, '\S+')) < 4 AND length(text) < 16 AS tiny,
        coalesce(bbox.y0 < lag(bbox.y0) OVER (PARTITION BY paper_version_id, page ORDER BY block_index, block_id) - 1, false) AS up FROM {_ONE} WHERE block_type = 'TEXT'),
      g AS (SELECT paper_version_id, page, sum(chars) AS chars, count(*) AS n, count_if(tiny) AS tiny, count_if(up) AS up FROM p GROUP BY ALL),
      v AS (SELECT paper_version_id, count(*) AS pages, round(avg(least(1.0, chars / 2200)), 4) AS coverage, round(sum(tiny) / sum(n), 4) AS fragment_ratio, sum(up)::BIGINT AS inversions FROM g GROUP BY ALL)
      SELECT *, (coverage < 0.4)::INT + (fragment_ratio > 0.1)::INT + (inversions > pages)::INT AS issues,
        CASE WHEN issues >= 2 THEN 'LOW' WHEN issues = 1 THEN 'SUSPECT' ELSE 'GOOD' END AS verdict FROM v""",
    "repeated_margins": f"""WITH t AS (SELECT paper_version_id, count(DISTINCT page) AS n FROM {_ONE} GROUP BY ALL),
      s AS (SELECT paper_version_id, trim(regexp_replace(lower(text), '[0-9]+', '#', 'g')) AS line, count(DISTINCT page) AS pages FROM {_ONE} WHERE length(text) <= 60 AND block_type = 'TEXT' GROUP BY ALL)
      SELECT paper_version_id, line, pages FROM s JOIN t USING (paper_version_id) WHERE pages >= greatest(2, ceil(n * 0.6))""",
    "batch_context": f"""SELECT block_id, ((row_number() OVER w - 1) // 6)::INT AS batch, lag(block_id, 2) OVER w AS before_two, lag(block_id) OVER w AS before, lead(block_id) OVER w AS after
      FROM {_ONE} WHERE block_type = 'TEXT' AND length(text) > 40 WINDOW w AS ({_ORDER})""",
    "section_briefs": f"""SELECT section_id, left(concat_ws(' — ', nullif(section_path, ''), text), 300) AS brief FROM {_ONE} WHERE block_type = 'TEXT' AND section_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY page, block_index, block_id) = 1""",
    "layout_fingerprint": f"""WITH s AS (SELECT paper_version_id, round(font_size, 1) AS size, count(*) AS n FROM {_ONE} WHERE font_size IS NOT NULL GROUP BY ALL),
      b AS (SELECT paper_version_id, size AS body_size FROM s QUALIFY row_number() OVER (PARTITION BY paper_version_id ORDER BY n DESC, size) = 1)
      SELECT paper_version_id, round(avg(coalesce(is_bold::INT, 0)), 4) AS bold_share, count(DISTINCT round(bbox.x0 / 20)) AS columns, any_value(body_size) AS body_size
      FROM {_ONE} LEFT JOIN b USING (paper_version_id) GROUP BY paper_version_id""",
    "row_predicates": rf"""SELECT block_id, {_CELL} AS is_cell, regexp_matches(text, '(?:^|\s)[±+\-–—]?[0-9]+(?:\.[0-9]+)?%?(?:\s+[±+\-–—]?[0-9]+(?:\.[0-9]+)?%?){{2,}}(?:\s|$)') AS is_row FROM (SELECT *, {_TOK} AS tok FROM {_ONE})""",
    "token_estimates": f"SELECT chunk_id, {_TOKENS.format(t='text')} AS tokens, {_TOKENS.format(t='text')} - token_estimate AS drift FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks)",
    "match_forms": r"SELECT doc_id, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g'))) AS form_hash FROM documents",
    "hyphen_repair": r"SELECT doc_id, length(regexp_replace(text, '([A-Za-z])-\s+([a-z])', '\1\2', 'g')) AS chars FROM documents",
    "chunk_blocks": f"""SELECT chunk_id, string_agg(block_type, '>' ORDER BY pos) AS types FROM (SELECT chunk_id, unnest(block_ids) AS block_id, generate_subscripts(block_ids, 1) AS pos
      FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks)) JOIN {_ONE} USING (block_id) GROUP BY chunk_id""",
    "span_blocks": """SELECT chunk_id, s.block_id AS block_id, s.block_char_start + greatest(s.chunk_char_start, 100) - s.chunk_char_start AS from_char,
      s.block_char_start + least(s.chunk_char_end, 400) - s.chunk_char_start AS to_char FROM (SELECT chunk_id, unnest(segments) AS s FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks))
      WHERE greatest(s.chunk_char_start, 100) < least(s.chunk_char_end, 400)""",
    "caption_nearest": f"""WITH b AS (SELECT block_id, paper_version_id, page, block_type, (bbox.x0 + bbox.x1) / 2 AS cx, (bbox.y0 + bbox.y1) / 2 AS cy FROM {_ONE})
      SELECT f.block_id AS formula, c.block_id AS caption, round(abs(f.cx - c.cx) + abs(f.cy - c.cy), 4) AS distance FROM b f JOIN b c USING (paper_version_id, page)
      WHERE f.block_type = 'FORMULA' AND c.block_type = 'CAPTION' QUALIFY row_number() OVER (PARTITION BY f.block_id ORDER BY round(abs(f.cx - c.cx) + abs(f.cy - c.cy), 4), c.block_id) = 1""",
}
