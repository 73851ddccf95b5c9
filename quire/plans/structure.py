"""Queries on layout signs, projections, selections and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import evidence as E, layout as L, service as V, structure as S
from quire.plans import document as D
from quire.plans.document import _ONE, blocks
from quire.sources.tables import latest, table

_SEC = "(SELECT DISTINCT ON (section_id) * FROM sections ORDER BY section_id, start_page NULLS FIRST)"


def one_sections(spark, root):
    return table(spark, root, "sections").dropDuplicates(["section_id"])


def one_chunks(spark, root, *more):
    return table(spark, root, "chunks", "chunk_id", "paper_version_id", "section_path", "page_start", "page_end", "text", *more).dropDuplicates(["chunk_id"])


def formula_lines(spark, root):
    return blocks(spark, root).where("text is not null").select("block_id", L.formula_like(F.col("text")).alias("is_formula"))


def author_blocks(spark, root):
    return table(spark, root, "provider_records", "record_id", "authors").select("record_id", L.author_block(F.array_join("authors", ", ")).alias("is_authors")).distinct()


def legacy_blocks(spark, root):
    return L.legacy_blocks(blocks(spark, root))


def canonical_nodes(spark, root):
    return L.nodes(blocks(spark, root)).drop("text")


def nodes_round_trip(spark, root):
    return L.blocks_of(L.nodes(blocks(spark, root)))


def body_fonts(spark, root):
    return L.body_font(blocks(spark, root))


def standalone_lines(spark, root):
    return L.standalone_line(blocks(spark, root)).select("block_id", "standalone")


def column_thresholds(spark, root):
    return L.column_thresholds(blocks(spark, root))


def largest_titles(spark, root):
    return L.largest_title(blocks(spark, root))


def inherited_kinds(spark, root):
    return L.inherited_kinds(one_sections(spark, root))


def ancestor_paths(spark, root):
    return L.ancestor_paths(one_sections(spark, root).withColumn("title", F.col("raw_title")))


def outside_references(spark, root):
    return L.outside_references(one_sections(spark, root)).select("section_id", "paper_version_id")


def outside_media(spark, root):
    b = blocks(spark, root)
    return L.outside_media(b.where("block_type = 'HEADING'"), b.where(F.col("block_type").isin("TABLE_ROW", "FIGURE", "CAPTION", "TABLE"))).select("block_id")


def before_references(spark, root):
    return L.before_references(blocks(spark, root), one_sections(spark, root)).select("block_id")


def formula_context(spark, root):
    return L.formula_context(blocks(spark, root))


def media_ranks(spark, root):
    return L.media_ranks(blocks(spark, root), ["CAPTION", "FORMULA", "TABLE_ROW"])


def section_texts(spark, root):
    return L.section_texts(blocks(spark, root))


def heading_scores(spark, root):
    got = blocks(spark, root).where("block_type = 'HEADING' and text is not null").select("paper_version_id", F.col("text").alias("title"), "page")
    gold = one_sections(spark, root).where("title is not null").select("paper_version_id", "title", F.col("start_page").alias("page"))
    return L.heading_scores(got, gold)


def same_units(spark, root):
    b = blocks(spark, root).where("text is not null")
    return b.select("block_id", L.same_unit(F.concat(F.lit(" $"), "text", F.lit("$")), F.col("text")).alias("kept"), L.same_unit(F.upper("text"), F.col("text")).alias("upper_kept"))


def safe_names(spark, root):
    return table(spark, root, "paper_versions", "version_id", "file_name").dropDuplicates(["version_id"]).select("version_id", L.safe_name(F.concat(F.lit("in/put/"), "file_name")).alias("name"))


def first_sentences(spark, root):
    return table(spark, root, "documents", "doc_id", "text").select("doc_id", L.first_sentence(F.col("text")).alias("sentence"))


def numeric_results(spark, root):
    r = latest(table(spark, root, "results", "result_id", "raw_text", "ingested_at"), "result_id")
    return r.select("result_id", L.numeric_result(F.col("raw_text")).alias("number"))


def chinese_digits(spark, root):
    return table(spark, root, "documents", "doc_id", "text").where("text is not null").select("doc_id", F.md5(L.chinese_digits(F.col("text")).cast("binary")).alias("digest"))


def author_surnames(spark, root):
    r = table(spark, root, "provider_records", "record_id", "authors").select("record_id", F.get("authors", F.lit(0)).alias("name")).where("name rlike '^[ -~]+$'").distinct()
    return r.select("record_id", "name", L.surname(F.col("name")).alias("surname"))


def corpus_units(spark, root):
    v = table(spark, root, "paper_versions", "version_id", "parse_status").where("parse_status is not null").select(F.col("version_id").alias("paper_version_id"))
    return V.corpus(one_chunks(spark, root), v).select("unit_id", "paper_version_id", "page")


def tenant_papers(spark, root):
    p = latest(table(spark, root, "papers", "paper_id", "user_id", "created_at"), "paper_id", "created_at")
    return V.owned(p, "guest").select("paper_id", "user_id")


def scoped_chunks(spark, root):
    c = table(spark, root, "chunks", "chunk_id", "block_ids").dropDuplicates(["chunk_id"])
    return V.scoped(c, blocks(spark, root).where("block_type = 'FORMULA'")).select("chunk_id")


def results_containing(spark, root):
    r = latest(table(spark, root, "results", "result_id", "dataset", "metric", "ingested_at"), "result_id")
    return V.containing(r, metric="time").select("result_id")


def method_graph(spark, root):
    line = table(spark, root, "lineitem", "l_suppkey", "l_partkey", "l_returnflag")
    edges = line.select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.col("l_returnflag").alias("edge_type"))
    return V.kept_edges(edges, table(spark, root, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("node_id")))


def field_gate(spark, root):
    c = one_chunks(spark, root, "block_ids")
    fields = c.select(F.col("chunk_id").alias("field"), F.lit("FOUND").alias("status"), F.col("block_ids").alias("evidence_ids"))
    known = blocks(spark, root).where("block_type = 'FORMULA'").select(F.col("block_id").alias("evidence_id"))
    return V.gated_fields(fields, known).select("field", "status", F.array_join("evidence_ids", ",").alias("evidence_ids"))


def missing_sections(spark, root):
    b = blocks(spark, root).where("section_id is not null and block_type = 'FORMULA'").select("section_id").distinct()
    return V.missing_fields(one_sections(spark, root).select("section_id"), b, ["section_id"])


def key_sets(spark, root):
    return V.key_sets(table(spark, root, "papers", "paper_id"), table(spark, root, "documents", "paper_id").where("paper_id is not null"), "paper_id")


def chosen_versions(spark, root):
    v = latest(table(spark, root, "paper_versions", "version_id", "paper_id", "created_at", "version_label", "ingested_at"), "version_id")
    return V.chosen_version(v, v.where("version_label = 'v2'").select("paper_id", "version_id"))


def reading_order(spark, root):
    return V.reading_order(blocks(spark, root), ["paper_version_id"]).select("block_id", "order_index")


def usage_counts(spark, root):
    return V.usage(table(spark, root, "events", "user_id", "event_type", "value"), ["user_id", "event_type"])


def verdict_counts(spark, root):
    return V.verdict_counts(S.page_gate(blocks(spark, root)))


def parse_benchmark(spark, root):
    return V.parse_benchmark(S.quality_report(blocks(spark, root)))


def parse_snapshot(spark, root):
    return V.parse_snapshot(blocks(spark, root))


def label_accuracy(spark, root):
    d = table(spark, root, "documents", "lang").select(F.lower("lang").alias("a"), F.lit("en").alias("b"))
    return V.accuracy(d, "a", "b")


def requirements(spark, root):
    return V.requirements(table(spark, root, "documents", "source", "text").where("source is not null"), "source")


def evidence_packages(spark, root):
    items = one_chunks(spark, root).select("paper_version_id", F.col("chunk_id").alias("evidence_id"), "text")
    return V.evidence_package(items, "paper_version_id")


def evidence_labels(spark, root):
    return E.ledger_from_hits(one_chunks(spark, root)).select("chunk_id", "evidence_id", "label")


def run_reports(spark, root):
    f = one_sections(spark, root).where("raw_title is not null").select("paper_version_id", F.col("section_id").alias("place"), F.col("raw_title").alias("text"))
    return V.run_report(f, "paper_version_id")


def stable_json(spark, root):
    return V.stable_json(table(spark, root, "nation", "n_nationkey", "n_name", "n_regionkey"), "n_nationkey")


def safe_json(spark, root):
    e = table(spark, root, "events", "event_id", "props")
    return e.select("event_id", V.safe_json(F.col("props"), "$.k", "none").alias("k"))


def rewritten_status(spark, root):
    v = table(spark, root, "nation", "n_nationkey", "n_name")
    return V.rewritten(v, "n_nationkey", [1, 3, 5], {"n_name": F.lower("n_name")})


def migrated_columns(spark, root):
    return V.migrated(table(spark, root, "region", "r_regionkey", "r_name"), {"r_name": "string", "r_note": "string"}).fillna("", ["r_note"])


def claim_guard(spark, root):
    d = table(spark, root, "documents", "doc_id", "text").where("text is not null and length(text) >= 60")
    quote = F.substring("text", 1, 40)
    claims = d.select(F.concat(F.lit("c-"), "doc_id").alias("claim_id"), F.concat(quote, F.lit(" 12345.5% outperform")).alias("text"))
    links = d.select(F.concat(F.lit("c-"), "doc_id").alias("claim_id"), F.concat(F.lit("e-"), "doc_id").alias("evidence_id"), quote.alias("quote"), F.lit(0).alias("char_start"), F.lit(40).alias("char_end"))
    ledger = d.select(F.concat(F.lit("e-"), "doc_id").alias("evidence_id"), F.col("text").alias("excerpt"))
    return E.guard(claims, links, ledger).select("claim_id", "accepted", F.array_contains("reasons", "NUMBER_NOT_IN_EVIDENCE:12345.5%").alias("number"), F.array_contains("reasons", "COMPARISON_DIRECTION_UNSUPPORTED").alias("comparison"))


_NAMES = """formula_lines author_blocks legacy_blocks canonical_nodes nodes_round_trip body_fonts standalone_lines column_thresholds largest_titles inherited_kinds ancestor_paths
outside_references outside_media before_references formula_context media_ranks section_texts heading_scores same_units safe_names first_sentences numeric_results chinese_digits
author_surnames corpus_units tenant_papers scoped_chunks results_containing method_graph field_gate missing_sections key_sets chosen_versions reading_order usage_counts verdict_counts
parse_benchmark parse_snapshot label_accuracy requirements evidence_packages evidence_labels run_reports stable_json safe_json rewritten_status migrated_columns claim_guard"""
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_SYM = "[=∑∏∫√±×÷≤≥≈∞α-ωΑ-Ω_^{}|]"
_CH = "(SELECT DISTINCT ON (chunk_id) * FROM chunks)"
_TYPE = "CASE block_type WHEN 'TABLE' THEN 'TABLE_ROW' WHEN 'FIGURE' THEN 'UNKNOWN_MEDIA' ELSE coalesce(nullif(block_type, ''), 'TEXT') END"
_ROW = r"(?:^|\s)[±+\-–—]?[0-9]+(?:\.[0-9]+)?%?(?:\s+[±+\-–—]?[0-9]+(?:\.[0-9]+)?%?){2,}(?:\s|$)"
_FORM = r"trim(regexp_replace(replace(lower(coalesce(title, '')), 'ß', 'ss'), '[^\p{L}\p{N}_]+', ' ', 'g'))"
_MARKS = {r: " OR ".join(f"contains(lower(text), '{m}')" for m in ms) for r, ms in V.REQUIREMENTS.items()}
SQL = {
    "formula_lines": f"""SELECT block_id, length(text) BETWEEN 5 AND 240 AND len(regexp_extract_all(text, '{_SYM}')) >= 2 AND len(regexp_extract_all(text, '{_SYM}')) * 5 >= length(text)
      AND len(regexp_extract_all(text, '[A-Za-z]{{3,}}')) <= 3 AS is_formula FROM {_ONE} WHERE text IS NOT NULL""",
    "author_blocks": r"""WITH a AS (SELECT record_id, array_to_string(authors, ', ') AS t FROM provider_records), w AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+') AS w FROM a),
      c AS (SELECT *, len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) AS c FROM w)
      SELECT DISTINCT record_id, coalesce(length(t) <= 200 AND len(w) > 0 AND c >= 0.65 * len(w) AND (regexp_matches(t, '\sand\s') OR contains(t, ',') OR c = len(w)), false) AS is_authors FROM c""",
    "legacy_blocks": f"SELECT block_id, paper_version_id, page, {_TYPE} AS block_type, text, section_id FROM {_ONE}",
    "canonical_nodes": f"""SELECT 'node-' || block_id AS node_id, 'rev-' || left(sha256(block_id || '|' || sha256(coalesce(text, ''))), 16) AS revision_id, paper_version_id AS source_version_id,
      {_TYPE} AS node_type, section_id AS parent_id, block_index AS order_index, page, sha256(coalesce(text, '')) AS content_hash FROM {_ONE}""",
    "nodes_round_trip": f"SELECT block_id, paper_version_id, page, block_index, section_id, text FROM {_ONE}",
    "body_fonts": f"""SELECT paper_version_id, round(median(font_size), 4) AS median_font, round(list_sort(list(bbox.x1 - bbox.x0) FILTER (WHERE bbox.x1 - bbox.x0 >= 50))[count(*) FILTER (WHERE bbox.x1 - bbox.x0 >= 50) // 2 + 1], 4) AS upper_width
      FROM {_ONE} WHERE block_type = 'TEXT' GROUP BY paper_version_id""",
    "standalone_lines": rf"""WITH b AS (SELECT *, trim(coalesce(text, '')) AS t FROM {_ONE}), f AS (SELECT *, len(regexp_split_to_array(t, '\s+')) <= 8 AS few FROM b)
      SELECT block_id, t = '' OR regexp_matches(t, '(?i)^(figure|fig\.|table|algorithm)\s*[0-9]+') OR regexp_matches(t, '{_ROW}') OR regexp_matches(t, '^[0-9]{{1,4}}$')
        OR (few AND (regexp_matches(t, '^[0-9]+(\.[0-9]+)*[.)]?\s+[A-Z]') OR coalesce(font_size >= 10.8, false) OR (coalesce(is_bold, false) AND coalesce(bbox.x1 - bbox.x0 < 260, false)))) AS standalone FROM f""",
    "column_thresholds": f"""WITH w AS (SELECT paper_version_id, page, bbox.x0 AS x, lead(bbox.x0) OVER (PARTITION BY paper_version_id, page ORDER BY bbox.x0) AS nxt, count(*) OVER (PARTITION BY paper_version_id, page) AS n
        FROM {_ONE} WHERE bbox.x1 - bbox.x0 <= 612 * 0.55 AND bbox.x1 - bbox.x0 >= 50)
      SELECT paper_version_id, page, round((x + nxt) / 2, 4) AS threshold FROM w WHERE n >= 4 AND nxt IS NOT NULL QUALIFY row_number() OVER (PARTITION BY paper_version_id, page ORDER BY nxt - x DESC, x) = 1 AND nxt - x > 30.6""",
    "largest_titles": f"""WITH f AS (SELECT *, max(font_size) OVER (PARTITION BY paper_version_id) AS top FROM {_ONE} WHERE page = 1 AND font_size IS NOT NULL AND trim(text) != ''),
      r AS (SELECT *, row_number() OVER (PARTITION BY paper_version_id ORDER BY block_index, block_id) AS k FROM f WHERE font_size >= top * 0.92)
      SELECT paper_version_id, string_agg(trim(text), ' ' ORDER BY k) AS title FROM r WHERE k <= 3 GROUP BY 1""",
    "inherited_kinds": f"""WITH RECURSIVE s AS (SELECT section_id, parent_id, canonical_name FROM {_SEC}), up AS (SELECT section_id, parent_id, canonical_name AS kind, 0 AS n FROM s
        UNION ALL SELECT up.section_id, s.parent_id, s.canonical_name, n + 1 FROM up JOIN s ON s.section_id = up.parent_id WHERE up.kind IS NULL AND n < 4)
      SELECT section_id, arg_max(kind, n) AS kind FROM (SELECT section_id, kind, n FROM up) GROUP BY section_id""",
    "ancestor_paths": f"""WITH RECURSIVE s AS (SELECT section_id, parent_id, coalesce(raw_title, '') AS title FROM {_SEC}), up AS (SELECT section_id, parent_id, title AS path, 0 AS n FROM s
        UNION ALL SELECT up.section_id, s.parent_id, s.title || ' > ' || path, n + 1 FROM up JOIN s ON s.section_id = up.parent_id WHERE n < 4)
      SELECT section_id, arg_max(path, n) AS path FROM up GROUP BY section_id""",
    "outside_references": f"""WITH s AS (SELECT * FROM {_SEC}), r AS (SELECT paper_version_id, min(start_page) AS a, max(coalesce(end_page, start_page)) AS b FROM s WHERE canonical_name = 'references' GROUP BY 1)
      SELECT section_id, s.paper_version_id FROM s LEFT JOIN r ON r.paper_version_id = s.paper_version_id WHERE NOT coalesce(start_page >= a AND start_page <= b AND canonical_name IS NULL, false)""",
    "outside_media": f"""WITH b AS (SELECT * FROM {_ONE}) SELECT block_id FROM b h WHERE block_type = 'HEADING' AND NOT EXISTS (SELECT 1 FROM b m WHERE m.block_type IN ('TABLE_ROW', 'FIGURE', 'CAPTION', 'TABLE')
      AND m.paper_version_id = h.paper_version_id AND m.page = h.page AND (h.bbox.x0 + h.bbox.x1) / 2 BETWEEN m.bbox.x0 AND m.bbox.x1 AND (h.bbox.y0 + h.bbox.y1) / 2 BETWEEN m.bbox.y0 AND m.bbox.y1)""",
    "before_references": f"""WITH r AS (SELECT paper_version_id, min(start_page) AS p FROM {_SEC} WHERE canonical_name = 'references' GROUP BY 1)
      SELECT block_id FROM {_ONE} b LEFT JOIN r ON r.paper_version_id = b.paper_version_id WHERE p IS NULL OR page < p""",
    "formula_context": rf"""WITH b AS (SELECT *, CASE WHEN block_type = 'TEXT' THEN left(text, 150) END AS t FROM {_ONE}),
      s AS (SELECT *, last_value(t IGNORE NULLS) OVER (PARTITION BY paper_version_id, page ORDER BY block_index, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
        first_value(t IGNORE NULLS) OVER (PARTITION BY paper_version_id, page ORDER BY block_index, block_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM b)
      SELECT block_id, nullif(regexp_extract(text, '\(([0-9]+)\)\s*$', 1), '') AS number, before, after FROM s WHERE block_type = 'FORMULA'""",
    "media_ranks": f"""SELECT block_id, rank FROM (SELECT block_id, block_type, row_number() OVER (PARTITION BY paper_version_id, page ORDER BY bbox.y0 NULLS FIRST, block_id) AS rank FROM {_ONE}) WHERE block_type IN ('CAPTION', 'FORMULA', 'TABLE_ROW')""",
    "section_texts": f"SELECT section_id, string_agg(text, chr(10) ORDER BY page, block_index, block_id) AS text FROM {_ONE} WHERE block_type = 'TEXT' AND section_id IS NOT NULL AND text IS NOT NULL GROUP BY section_id",
    "heading_scores": rf"""WITH p AS (SELECT DISTINCT paper_version_id, {_FORM} AS title, page, 1 AS p FROM (SELECT paper_version_id, text AS title, page FROM {_ONE} WHERE block_type = 'HEADING' AND text IS NOT NULL)),
      g AS (SELECT DISTINCT paper_version_id, {_FORM} AS title, start_page AS page, 1 AS g FROM {_SEC} WHERE title IS NOT NULL),
      b AS (SELECT paper_version_id, coalesce(sum(p * g), 0) AS hit, coalesce(sum(p), 0) AS p, coalesce(sum(g), 0) AS g FROM p FULL JOIN g USING (paper_version_id, title, page) GROUP BY 1)
      SELECT paper_version_id, round(coalesce(hit / nullif(p, 0), 0), 6) AS precision, round(coalesce(hit / nullif(g, 0), 0), 6) AS recall, round(coalesce(hit / nullif((p + g) / 2, 0), 0), 6) AS f1 FROM b""",
    "same_units": rf"""WITH n AS (SELECT block_id, left(regexp_replace(text, '[\s$]+', '', 'g'), 80) AS a, left(regexp_replace(upper(text), '[\s$]+', '', 'g'), 80) AS u FROM {_ONE} WHERE text IS NOT NULL)
      SELECT block_id, a != '' AS kept, a != '' AND a = u AS upper_kept FROM n""",
    "safe_names": r"SELECT version_id, CASE WHEN file_name IS NULL THEN 'paper.pdf' ELSE coalesce(nullif(regexp_replace(regexp_extract(file_name, '([^/\\]*)$', 1), '[^A-Za-z0-9._-]+', '_', 'g'), ''), 'paper.pdf') END AS name FROM (SELECT DISTINCT ON (version_id) * FROM paper_versions)",
    "first_sentences": r"""WITH t AS (SELECT doc_id, trim(coalesce(text, '')) AS t FROM documents) SELECT doc_id, CASE WHEN regexp_extract(t, '(?s)^(.*?[.!?。！？])\s', 1) != '' THEN regexp_extract(t, '(?s)^(.*?[.!?。！？])\s', 1) ELSE trim(left(t, 200)) END AS sentence FROM t""",
    "numeric_results": "SELECT result_id, try_cast(trim(replace(raw_text, '%', '')) AS DOUBLE) AS number FROM (SELECT DISTINCT ON (result_id) * FROM results ORDER BY result_id, ingested_at DESC NULLS LAST)",
    "chinese_digits": "SELECT doc_id, md5(translate(text, '零一二两三四五六七八九', '01223456789')) AS digest FROM documents WHERE text IS NOT NULL",
    "author_surnames": r"""WITH n AS (SELECT DISTINCT record_id, authors[1] AS name FROM provider_records WHERE regexp_full_match(authors[1], '[ -~]+'))
      SELECT record_id, name, string_split(trim(regexp_replace(lower(CASE WHEN contains(name, ',') THEN split_part(name, ',', 1) ELSE name END), '[^a-z0-9]+', ' ', 'g')), ' ')[-1] AS surname FROM n""",
    "corpus_units": f"SELECT chunk_id AS unit_id, paper_version_id, page_start AS page FROM {_CH} WHERE chunk_id IS NOT NULL AND trim(text) != '' AND paper_version_id IN (SELECT version_id FROM paper_versions WHERE parse_status IS NOT NULL)",
    "tenant_papers": "SELECT paper_id, user_id FROM (SELECT DISTINCT ON (paper_id) * FROM papers ORDER BY paper_id, created_at DESC NULLS LAST) WHERE user_id = 'guest'",
    "scoped_chunks": f"""WITH h AS (SELECT DISTINCT chunk_id FROM (SELECT chunk_id, unnest(block_ids) AS block_id FROM {_CH}) WHERE block_id IN (SELECT block_id FROM {_ONE} WHERE block_type = 'FORMULA'))
      SELECT chunk_id FROM {_CH} WHERE chunk_id IN (SELECT chunk_id FROM h) OR NOT EXISTS (SELECT 1 FROM h)""",
    "results_containing": "SELECT result_id FROM (SELECT DISTINCT ON (result_id) * FROM results ORDER BY result_id, ingested_at DESC NULLS LAST) WHERE contains(lower(metric), 'time')",
    "method_graph": "SELECT DISTINCT l_suppkey AS source_id, l_partkey AS target_id, l_returnflag AS edge_type FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) AND l_partkey IN (SELECT s_suppkey FROM supplier) AND l_suppkey != l_partkey",
    "field_gate": f"""WITH k AS (SELECT block_id FROM {_ONE} WHERE block_type = 'FORMULA'), e AS (SELECT chunk_id, unnest(block_ids) AS b FROM {_CH}),
      g AS (SELECT chunk_id, string_agg(DISTINCT b, ',' ORDER BY b) AS ids FROM e WHERE b IN (SELECT block_id FROM k) GROUP BY 1)
      SELECT c.chunk_id AS field, CASE WHEN ids IS NULL THEN 'NOT_FOUND_IN_SEARCHED' ELSE 'FOUND' END AS status, coalesce(ids, '') AS evidence_ids FROM {_CH} c LEFT JOIN g USING (chunk_id)""",
    "missing_sections": f"SELECT section_id FROM {_SEC} WHERE section_id NOT IN (SELECT section_id FROM {_ONE} WHERE section_id IS NOT NULL AND block_type = 'FORMULA')",
    "key_sets": "SELECT paper_id, CASE WHEN l IS NULL THEN 'right' WHEN r IS NULL THEN 'left' ELSE 'both' END AS side FROM (SELECT DISTINCT paper_id, 1 AS l FROM papers) FULL JOIN (SELECT DISTINCT paper_id, 1 AS r FROM documents WHERE paper_id IS NOT NULL) USING (paper_id)",
    "chosen_versions": """WITH v AS (SELECT DISTINCT ON (version_id) * FROM paper_versions ORDER BY version_id, ingested_at DESC NULLS LAST)
      SELECT paper_id, coalesce(min(version_id) FILTER (WHERE version_label = 'v2'), first(version_id ORDER BY created_at NULLS FIRST, version_id)) AS version_id FROM v GROUP BY paper_id""",
    "reading_order": f"SELECT block_id, row_number() OVER (PARTITION BY paper_version_id ORDER BY page, bbox.y0 NULLS FIRST, bbox.x0 NULLS FIRST, block_id) - 1 AS order_index FROM {_ONE}",
    "usage_counts": "SELECT user_id, event_type, count(*) AS calls, round(sum(coalesce(value, 0)), 4) AS value FROM events GROUP BY ALL",
    "verdict_counts": f"SELECT paper_version_id, count_if(verdict = 'GOOD') AS good, count_if(verdict = 'SUSPECT') AS suspect, count_if(verdict = 'LOW') AS low FROM ({D.SQL['page_gate']}) GROUP BY 1",
    "parse_benchmark": f"""SELECT count(*) AS versions, round(avg((verdict = 'GOOD')::INT), 6) AS good_ratio, round(avg(coverage), 4) AS coverage, round(avg(fragment_ratio), 4) AS fragment_ratio FROM ({D.SQL['quality_report']})""",
    "claim_guard": f"""SELECT 'c-' || doc_id AS claim_id, false AS accepted, NOT contains(text, '12345.5%') AS number, NOT ({' OR '.join(f"contains(lower(text), '{w}')" for w in E.COMPARATORS)}) AS comparison
      FROM documents WHERE length(text) >= 60""",
    "parse_snapshot": f"""WITH b AS (SELECT paper_version_id, avg((length(trim(text)) = 1)::INT) AS single, avg((length(trim(text)) <= 2)::INT) AS short, count_if(block_type = 'TABLE_ROW') AS rows, count_if(block_type = 'FORMULA') AS formulas
      FROM {_ONE} WHERE text IS NOT NULL GROUP BY 1) SELECT count(*) AS versions, round(avg(single), 4) AS single, round(avg(short), 4) AS short, round(avg(rows), 4) AS rows, round(avg(formulas), 4) AS formulas FROM b""",
    "label_accuracy": "SELECT count(*) AS cases, round(avg(coalesce((lower(lang) = 'en')::INT, 0)), 6) AS accuracy FROM documents",
    "requirements": " UNION ALL ".join(f"SELECT source, '{r}' AS requirement, coalesce(bool_or({m}), false) AS given FROM documents WHERE source IS NOT NULL GROUP BY source" for r, m in _MARKS.items()),
    "evidence_packages": f"""SELECT paper_version_id, '<EVIDENCE>' || chr(10) || chr(10) || string_agg('EVIDENCE_ID: ' || chunk_id || chr(10) || 'TEXT_START' || chr(10) || CASE WHEN length(text) > 6000 THEN left(text, 6000) || chr(10) || '…' ELSE coalesce(text, '') END || chr(10) || 'TEXT_END', chr(10) || chr(10) ORDER BY chunk_id)
      || chr(10) || chr(10) || '</EVIDENCE>' AS package FROM {_CH} GROUP BY 1""",
    "evidence_labels": rf"""SELECT chunk_id, left(sha256(chunk_id || '|' || coalesce(text, '')), 24) AS evidence_id, '[Paper, PDF ' || CASE WHEN page_start IS NOT DISTINCT FROM page_end THEN 'p.' || coalesce(page_start::VARCHAR, 'None')
      ELSE 'pp.' || coalesce(page_start::VARCHAR, 'None') || '-' || coalesce(page_end::VARCHAR, 'None') END || ', ' || trim(regexp_replace(replace(coalesce(section_path, ''), chr(173), ''), '[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g')) || ']' AS label FROM {_CH}""",
    "run_reports": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY paper_version_id ORDER BY section_id) AS k FROM {_SEC} WHERE raw_title IS NOT NULL)
      SELECT paper_version_id, '# ' || paper_version_id || chr(10) || chr(10) || string_agg('- ' || raw_title, chr(10) ORDER BY k) AS report FROM r WHERE k <= 12 GROUP BY 1""",
    "stable_json": """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json FROM nation""",
    "safe_json": "SELECT event_id, coalesce(CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END, 'none') AS k FROM events",
    "rewritten_status": "SELECT n_nationkey, CASE WHEN n_nationkey IN (1, 3, 5) THEN lower(n_name) ELSE n_name END AS n_name FROM nation",
    "migrated_columns": "SELECT r_regionkey, r_name, '' AS r_note FROM region",
}
