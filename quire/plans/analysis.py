"""Queries on papers, results, evidence, terms, events and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import compare as C, evidence as E, jobs as J, records as K, terms as M
from quire.sources.tables import latest, table

#: The event types of the table read as stages of a job.
EVENT_STAGES = {"view": "file_validation", "click": "metadata_and_pages", "purchase": "layout_and_text", "signup": "sections"}
_RES = "(SELECT DISTINCT ON (result_id) * FROM results ORDER BY result_id, ingested_at DESC NULLS LAST)"
_KEY = "CASE regexp_replace(lower(trim(coalesce({c}, ''))), '[_\\- ]+', ' ', 'g') " + " ".join(f"WHEN '{a}' THEN '{d}'" for a, d in C.DATASETS.items()) + " ELSE regexp_replace(lower(trim(coalesce({c}, ''))), '[_\\- ]+', ' ', 'g') END"
_key = lambda c: _KEY.replace("{c}", c)


def results(spark, root):
    return latest(table(spark, root, "results"), "result_id")


def papers_overview(spark, root):
    """Papers with their number of versions and the newest version."""
    p = table(spark, root, "papers").select("paper_id", "canonical_title", "user_id").dropDuplicates(["paper_id"])
    v = table(spark, root, "paper_versions").dropDuplicates(["version_id"])
    by = v.groupBy("paper_id").agg(F.count("*").alias("versions"), F.max_by("version_id", F.struct("created_at", "version_id")).alias("newest"))
    return p.join(by, "paper_id", "left").select("paper_id", F.coalesce("versions", F.lit(0)).alias("versions"), "newest")


def user_quota(spark, root):
    return table(spark, root, "papers").groupBy("user_id").agg(F.count_distinct("paper_id").alias("papers"))


def recent_papers(spark, root):
    p = table(spark, root, "papers", "paper_id", "created_at").dropDuplicates(["paper_id"])
    return p.orderBy(F.desc_nulls_last("created_at"), "paper_id").limit(20)


def keep_latest(spark, root):
    return results(spark, root).select("result_id", "paper_id", "metric", "ingested_at")


def append_new(spark, root):
    v = table(spark, root, "paper_versions", "version_id", "source").dropDuplicates(["version_id"])
    old, new = v.where(F.col("source") == "upload"), v
    return K.append_new(old, new, "version_id").groupBy("source").agg(F.count("*").alias("n"))


def delete_cascade(spark, root):
    v = table(spark, root, "paper_versions", "version_id", "paper_id", "parse_status").dropDuplicates(["version_id"])
    gone = v.where(F.lower("parse_status") == "failed").select("paper_id")
    p = table(spark, root, "papers", "paper_id").dropDuplicates(["paper_id"])
    a, b = K.delete_cascade(p, v.select("paper_id", "version_id"), gone, "paper_id")
    return a.agg(F.count("*").alias("papers")).crossJoin(b.agg(F.count("*").alias("versions")))


def ttl_cache(spark, root):
    e = table(spark, root, "events", "event_id", "ts")
    return K.alive(e, "ts", 86400, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).where("ts < timestamp_ntz '2024-01-20 00:00:00'").select("event_id")


def align_results(spark, root):
    return C.aligned(results(spark, root))


def result_matrix(spark, root):
    r = results(spark, root).withColumn("setting", F.coalesce(F.nullif("condition", F.lit("")), F.lit("none")))
    return C.matrix(r, ["5-shot", "fine-tuned", "zero-shot", "none"], "setting").select(
        "dataset", "metric", F.col("5-shot").alias("five_shot"), F.col("fine-tuned").alias("fine_tuned"), F.col("zero-shot").alias("zero_shot"), F.col("none").alias("unset")
    )


def result_compare(spark, root):
    return C.compared(results(spark, root)).select("dataset", "metric", "papers", "same_key", "best_paper")


def _cells(spark, root):
    r = results(spark, root).where("metric is not null")
    return r.groupBy("paper_id", C.key_name(F.col("metric")).alias("dimension")).agg(F.max(F.nullif("condition", F.lit(""))).alias("value"))


def densify_cells(spark, root):
    p = table(spark, root, "papers", "paper_id").where("paper_id is not null")
    c = _cells(spark, root)
    grid = C.densified(c, p, table(spark, root, "metric_units").select(C.key_name(F.col("metric")).alias("dimension")))
    return grid.groupBy("dimension", "status").agg(F.count("*").alias("papers"))


def gap_analysis(spark, root):
    n = table(spark, root, "papers").where("paper_id is not null").agg(F.count_distinct("paper_id")).first()[0]
    return C.gaps(_cells(spark, root), n)


def consensus(spark, root):
    return C.consensus(_cells(spark, root))


def rubric_score(spark, root):
    """Marks of papers by section kind: 4 for a long section, 2 for a short one, weighed by the rubric."""
    s = table(spark, root, "sections", "section_id", "paper_version_id", "canonical_name", "confidence").dropDuplicates(["section_id"])
    marks = s.where("canonical_name is not null").groupBy(F.col("paper_version_id").alias("paper_id"), F.col("canonical_name").alias("dimension")).agg(
        F.max(F.when(F.col("confidence") >= 0.8, 4).otherwise(2)).alias("score")
    )
    weights = s.sparkSession.createDataFrame([("method", 40), ("experiments", 30), ("results", 20), ("introduction", 10)], "dimension string, weight int")
    return C.rubric(marks, weights)


def quote_locate(spark, root):
    """The opening words of every test passage as quotes against documents named by position."""
    return E.locate(_links(spark, root), _ledger(spark, root)).select("claim_id", "reason", F.col("at").cast("int").alias("at"))


def _ledger(spark, root):
    d = table(spark, root, "documents", "doc_id", "text")
    return d.select(F.concat(F.lit("ev-"), "doc_id").alias("evidence_id"), F.col("text").alias("excerpt"))


def _links(spark, root):
    d = table(spark, root, "documents", "doc_id", "text")
    # Each document's characters 5 to 45 claimed at 5, at a wrong place, from the next document, and from nowhere.
    quote = F.substring("text", 6, 40)
    make = lambda n, ev, a, b: d.select(F.concat(F.lit(f"{n}-"), "doc_id").alias("claim_id"), ev.alias("evidence_id"), quote.alias("quote"), F.lit(a).alias("char_start"), F.lit(b).alias("char_end"))
    own = F.concat(F.lit("ev-"), F.col("doc_id"))
    return make("a", own, 5, 45).union(make("b", own, 0, 40)).union(make("c", F.concat(F.lit("ev-"), F.col("doc_id") + 1), 5, 45)).union(make("d", F.concat(F.lit("no-"), F.col("doc_id")), 5, 45)).union(make("e", own, 5, 1000000))


def claim_numbers(spark, root):
    d = table(spark, root, "documents", "doc_id", "text")
    return d.select("doc_id", F.array_join(T.numbers(F.col("text")), " ").alias("numbers"))


def claim_negation(spark, root):
    d = table(spark, root, "documents", "doc_id", "text")
    return d.select("doc_id", F.array_join(E.negations(F.col("text")), " ").alias("negations"), F.array_join(F.array_sort(E.comparators(F.col("text"))), " ").alias("comparators"))


def tm_exact(spark, root):
    """Documents whose text another document holds but for white space and case, with the smallest such id."""
    d = table(spark, root, "documents", "doc_id", "text").withColumn("h", M.memory_key(F.col("text")))
    by = d.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    return d.join(by, "h").select("doc_id", "first")


def term_resolution(spark, root):
    """Section titles as terms: the strongest layer wins; layers are told by level."""
    s = table(spark, root, "sections", "section_id", "title", "level", "confidence").dropDuplicates(["section_id"])
    scope = F.element_at(F.array(*[F.lit(x) for x in M.SCOPES]), F.least(F.coalesce("level", F.lit(5)), F.lit(5)))
    t = s.select(F.col("title").alias("source"), F.col("section_id").alias("target"), scope.alias("scope"), F.lit(False).alias("locked"), "confidence")
    return M.resolve(t).select("key", "target", "scope")


_TERMS = [("calibration", "Kalibrierung"), ("decoder", "Dekoder"), ("sparse", "dünn"), ("retrieval", "Abruf"), ("阈值", "threshold")]


def term_scan(spark, root):
    terms = spark.createDataFrame(_TERMS, "source string, target string")
    return M.scan(table(spark, root, "documents", "doc_id", "text"), terms, "doc_id", "text")


def glossary_drift(spark, root):
    """Each block against the next of its version: terms the second one lost."""
    terms = spark.createDataFrame([("calibration", "decoder"), ("sparse", "robust")], "source string, target string")
    b = latest(table(spark, root, "blocks", "block_id", "paper_version_id", "block_index", "text", "ingested_at"), "block_id")
    own = b.select(F.col("block_id").alias("unit_id"), "paper_version_id", "block_index", F.col("text").alias("source_text"))
    nxt = b.select("paper_version_id", (F.col("block_index") - 1).alias("block_index"), F.col("text").alias("target_text"))
    return M.drift(own, nxt, terms, ["paper_version_id", "block_index"]).select("unit_id", F.array_join("sources", ",").alias("sources"))


def topic_alignment(spark, root):
    """Sections' title words of each version against those of its paper's first version."""
    s = table(spark, root, "sections", "section_id", "paper_version_id", "title").dropDuplicates(["section_id"])
    v = table(spark, root, "paper_versions", "version_id", "paper_id").dropDuplicates(["version_id"])
    words = s.select("paper_version_id", F.explode(T.plain_tokens(F.col("title"))).alias("w")).groupBy("paper_version_id").agg(F.collect_set("w").alias("words"))
    own = v.join(words, v["version_id"] == words["paper_version_id"])
    first = own.groupBy("paper_id").agg(F.min_by("words", "version_id").alias("base"))
    j = F.round(T.jaccard(F.col("words"), F.col("base")), 6)
    return own.join(first, "paper_id").select("version_id", j.alias("similarity"), F.when(j >= 0.35, "SAME").when(j >= 0.15, "RELATED").otherwise("DIFFERENT").alias("relation"))


def _stage_events(spark, root):
    STAGE_OF = F.create_map(*[F.lit(x) for kv in EVENT_STAGES.items() for x in kv])
    e = table(spark, root, "events", "user_id", "event_type", "ts", "value")
    return e.select(F.col("user_id").alias("job_id"), STAGE_OF[F.col("event_type")].alias("stage"), "ts", F.least(F.lit(1.0), F.col("value") / 20).alias("ratio"))


def job_progress(spark, root):
    return J.progress(_stage_events(spark, root), J.WEIGHTS)


def job_stages(spark, root):
    return J.stages(_stage_events(spark, root)).select("job_id", "stage", "started", F.round("seconds", 3).alias("seconds"))


def status_tally(spark, root):
    v = table(spark, root, "paper_versions", "version_id", "paper_id", "parse_status").dropDuplicates(["version_id"])
    return J.tally(v.withColumn("s", F.lower("parse_status")), "paper_id", "s", ["parsed", "failed", "pending"])


def history_last(spark, root):
    from quire.sources.tables import ranked

    e = ranked(table(spark, root, "events", "event_id", "user_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return e.where("rank <= 6").select("user_id", "event_id", "rank")


def event_windows(spark, root):
    e = table(spark, root, "events", "ts", "event_type", "value")
    w = e.groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def supply_neighbours(spark, root):
    li = table(spark, root, "lineitem", "l_partkey", "l_suppkey").distinct()
    edges = li.select(F.concat(F.lit("p"), "l_partkey").alias("source_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_id"), F.lit("SUPPLIES").alias("edge_type"))
    return K.neighbours(edges).groupBy("node_id").agg(F.count("*").alias("degree"))


def region_rollup(spark, root):
    c = table(spark, root, "customer", "c_nationkey", "c_mktsegment", "c_acctbal")
    n = table(spark, root, "nation", "n_nationkey", "n_regionkey").join(F.broadcast(table(spark, root, "region", "r_regionkey", "r_name")), F.col("n_regionkey") == F.col("r_regionkey"))
    j = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup("r_name", "c_mktsegment").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def provider_near_years(spark, root):
    """Candidates of each record by surname-free title words: same words, years within one, the top and its margin."""
    p = table(spark, root, "provider_records", "record_id", "provider", "title", "year").where("title is not null").dropDuplicates(["record_id"])
    w = p.withColumn("key", F.array_join(F.array_sort(F.array_distinct(T.plain_tokens(F.col("title")))), " ")).where("key != ''")
    a, b = w.alias("a"), w.alias("b")
    both = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.provider") != F.col("b.provider")))
    score = 0.85 + F.when(F.col("a.year") == F.col("b.year"), 0.15).when(F.abs(F.col("a.year") - F.col("b.year")) == 1, 0.075).otherwise(0.0)
    s = both.select(F.col("a.record_id").alias("record_id"), F.round(score, 4).alias("score"), F.col("b.record_id").alias("other"))
    by = s.groupBy("record_id").agg(F.slice(F.sort_array(F.collect_list("score"), False), 1, 2).alias("t"), F.min_by("other", F.struct(-F.col("score"), F.col("other"))).alias("best"))
    margin = F.col("t")[0] - F.coalesce(F.get("t", F.lit(1)), F.lit(0.0))
    return by.select("record_id", "best", F.col("t")[0].alias("score"), F.when((F.col("t")[0] >= 0.78) & (margin < 0.08), "AMBIGUOUS").when(F.col("t")[0] >= 0.78, "PROBABLE").otherwise("UNRESOLVED").alias("status"))


QUERIES = {f.__name__: f for f in (
    papers_overview, user_quota, recent_papers, keep_latest, append_new, delete_cascade, ttl_cache, align_results, result_matrix, result_compare,
    densify_cells, gap_analysis, consensus, rubric_score, quote_locate, claim_numbers, claim_negation, tm_exact, term_resolution, term_scan,
    glossary_drift, topic_alignment, job_progress, job_stages, status_tally, history_last, event_windows, supply_neighbours, region_rollup, provider_near_years,
)}

_P = "(SELECT DISTINCT ON (paper_id) * FROM papers)"
_V = "(SELECT DISTINCT ON (version_id) * FROM paper_versions)"
_CELLS = f"cells AS (SELECT paper_id, {_key('metric')} AS dimension, max(nullif(condition, '')) AS value FROM {_RES} WHERE metric IS NOT NULL GROUP BY ALL)"
_NEG = ", ".join(f"'{w}'" for w in E.NEGATIONS)
_ZH = ", ".join(f"'{w}'" for w in E.NEGATIONS_ZH)
_CMP = ", ".join(f"'{w}'" for w in E.COMPARATORS)


def _value_sql(x: str) -> str:
    for pattern, into in T.NUMBER_FORMS:
        x = f"regexp_replace({x}, '{pattern}', '{into}')"
    return x


_W = "CASE stage " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in J.WEIGHTS.items()) + " ELSE 0 END"
_STAGES = "(SELECT user_id AS job_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_STAGES.items()) + " END AS stage, ts, least(1.0, value / 20) AS ratio FROM events)"
_TERM_VALUES = ", ".join(f"('{s}', '{t}')" for s, t in _TERMS)
SQL = {
    "papers_overview": f"""SELECT paper_id, (SELECT count(*) FROM {_V} v WHERE v.paper_id = p.paper_id) AS versions,
      (SELECT version_id FROM {_V} v WHERE v.paper_id = p.paper_id ORDER BY created_at DESC, version_id DESC LIMIT 1) AS newest FROM {_P} p""",
    "user_quota": "SELECT user_id, count(DISTINCT paper_id) AS papers FROM papers GROUP BY user_id",
    "recent_papers": f"SELECT paper_id, created_at FROM {_P} ORDER BY created_at DESC NULLS LAST, paper_id LIMIT 20",
    "keep_latest": "SELECT result_id, paper_id, metric, ingested_at FROM results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY ingested_at DESC NULLS LAST) = 1",
    "append_new": f"""WITH v AS (SELECT version_id, source FROM {_V}), o AS (SELECT * FROM v WHERE source = 'upload')
      SELECT source, count(*) AS n FROM (SELECT * FROM o UNION ALL SELECT * FROM v WHERE version_id NOT IN (SELECT version_id FROM o)) GROUP BY source""",
    "delete_cascade": f"""WITH g AS (SELECT DISTINCT paper_id FROM {_V} WHERE lower(parse_status) = 'failed' AND paper_id IS NOT NULL)
      SELECT (SELECT count(*) FROM {_P} WHERE paper_id IS NULL OR paper_id NOT IN (SELECT paper_id FROM g)) AS papers,
        (SELECT count(*) FROM {_V} WHERE paper_id IS NULL OR paper_id NOT IN (SELECT paper_id FROM g)) AS versions""",
    "ttl_cache": "SELECT event_id FROM events WHERE ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-20' AND ts < TIMESTAMP '2024-01-20'",
    "align_results": f"SELECT {_key('dataset')} AS dataset, {_key('task')} AS task, {_key('metric')} AS metric, count(*) AS records, count(DISTINCT paper_id) AS papers, max(CASE WHEN NOT isnan(value) THEN value END) AS best FROM {_RES} GROUP BY 1, 2, 3",
    "result_matrix": f"""SELECT {_key('dataset')} AS dataset, {_key('metric')} AS metric, round(avg(value) FILTER (condition = '5-shot'), 4) AS five_shot,
      round(avg(value) FILTER (condition = 'fine-tuned'), 4) AS fine_tuned, round(avg(value) FILTER (condition = 'zero-shot'), 4) AS zero_shot,
      round(avg(value) FILTER (nullif(condition, '') IS NULL), 4) AS unset FROM {_RES} WHERE NOT isnan(value) GROUP BY 1, 2""",
    "result_compare": f"""WITH l AS (SELECT * FROM {_RES} QUALIFY row_number() OVER (PARTITION BY dataset, metric, paper_id ORDER BY ingested_at DESC NULLS LAST, result_id DESC) = 1),
      g AS (SELECT dataset, metric, count(*) AS papers, count(DISTINCT nullif(condition, '')) <= 1 AS same_key FROM l GROUP BY ALL),
      b AS (SELECT dataset, metric, paper_id FROM l WHERE value IS NOT NULL AND NOT isnan(value) QUALIFY row_number() OVER (PARTITION BY dataset, metric ORDER BY value DESC, paper_id) = 1)
      SELECT g.dataset, g.metric, papers, same_key, CASE WHEN same_key THEN b.paper_id END AS best_paper FROM g LEFT JOIN b ON g.dataset IS NOT DISTINCT FROM b.dataset AND g.metric IS NOT DISTINCT FROM b.metric""",
    "densify_cells": f"""WITH {_CELLS} SELECT d.dimension AS dimension, CASE WHEN value IS NULL THEN 'NOT_FOUND' ELSE 'FOUND' END AS status, count(*) AS papers
      FROM (SELECT DISTINCT paper_id FROM papers WHERE paper_id IS NOT NULL) p CROSS JOIN (SELECT DISTINCT {_key('metric')} AS dimension FROM metric_units) d
      LEFT JOIN cells c ON c.paper_id = p.paper_id AND c.dimension = d.dimension GROUP BY 1, 2""",
    "gap_analysis": f"WITH {_CELLS} SELECT dimension, (SELECT count(DISTINCT paper_id) FROM papers) - count(DISTINCT CASE WHEN value IS NOT NULL THEN paper_id END) AS missing FROM cells GROUP BY dimension",
    "consensus": f"""WITH {_CELLS}, v AS (SELECT dimension, value, count(DISTINCT paper_id) AS support FROM cells WHERE value IS NOT NULL GROUP BY ALL),
      n AS (SELECT dimension, count(DISTINCT paper_id) AS papers FROM cells WHERE value IS NOT NULL GROUP BY ALL)
      SELECT dimension, value, support, papers FROM v JOIN n USING (dimension) WHERE papers >= 2 QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY support DESC, value) = 1 AND support >= greatest(2, ceil(papers / 2))""",
    "rubric_score": """WITH m AS (SELECT paper_version_id AS paper_id, canonical_name AS dimension, max(CASE WHEN confidence >= 0.8 THEN 4 ELSE 2 END) AS score
        FROM (SELECT DISTINCT ON (section_id) * FROM sections) WHERE canonical_name IS NOT NULL GROUP BY ALL),
      w(dimension, weight) AS (VALUES ('method', 40), ('experiments', 30), ('results', 20), ('introduction', 10)),
      s AS (SELECT paper_id, sum(weight) AS w, sum(weight * score / 4) AS s FROM m JOIN w USING (dimension) GROUP BY paper_id)
      SELECT paper_id, round(w / 100, 4) AS coverage, CASE WHEN w / 100 >= 0.7 THEN round(s, 4) END AS total FROM s""",
    "quote_locate": """WITH d AS (SELECT doc_id, text, substring(text, 6, 40) AS q FROM documents),
      l AS (SELECT 'a-' || doc_id AS claim_id, doc_id::VARCHAR AS ev, q, 5 AS s, 45 AS e FROM d UNION ALL SELECT 'b-' || doc_id, doc_id::VARCHAR, q, 0, 40 FROM d
        UNION ALL SELECT 'c-' || doc_id, (doc_id + 1)::VARCHAR, q, 5, 45 FROM d UNION ALL SELECT 'd-' || doc_id, NULL, q, 5, 45 FROM d UNION ALL SELECT 'e-' || doc_id, doc_id::VARCHAR, q, 5, 1000000 FROM d),
      j AS (SELECT l.*, d.text AS x, substring(d.text, s + 1, e - s) = l.q AS there, CASE WHEN length(l.q) > 0 THEN (length(d.text) - length(replace(d.text, l.q, ''))) / length(l.q) ELSE 0 END AS n
        FROM l LEFT JOIN d ON d.doc_id::VARCHAR = l.ev),
      r AS (SELECT *, CASE WHEN x IS NULL THEN 'UNKNOWN_EVIDENCE_ID' WHEN s < 0 OR e > length(x) OR s >= e THEN 'QUOTE_SPAN_OUT_OF_RANGE' WHEN there OR n = 1 THEN NULL ELSE 'QUOTE_NOT_UNIQUE_LITERAL_SUBSTRING' END AS reason FROM j)
      SELECT claim_id, reason, CASE WHEN reason IS NULL THEN CASE WHEN there THEN s WHEN n = 1 THEN instr(x, q) - 1 END END AS at FROM r""",
    "claim_numbers": f"""WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '{T.NUMBER}', 1)) AS said FROM documents),
      x AS (SELECT doc_id, replace(replace(replace(replace(said, '−', '-'), '–', '-'), ' ', ''), '+', '') AS x FROM n),
      e AS (SELECT doc_id, CASE WHEN contains(lower(x), 'e') THEN CAST(CAST(CAST(replace(x, '%', '') AS DOUBLE) AS DECIMAL(38,12)) AS VARCHAR) || CASE WHEN contains(x, '%') THEN '%' ELSE '' END ELSE x END AS x FROM x),
      v AS (SELECT DISTINCT doc_id, {_value_sql('x')} AS v FROM e)
      SELECT d.doc_id, coalesce(string_agg(v, ' ' ORDER BY v), '') AS numbers FROM documents d LEFT JOIN v USING (doc_id) WHERE text IS NOT NULL GROUP BY d.doc_id""",
    "claim_negation": f"""SELECT doc_id, array_to_string(list_sort(list_concat(list_intersect(list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z]+')), [{_NEG}]), list_distinct(regexp_extract_all(text, '{E.ZH_LONGEST_FIRST}')))), ' ') AS negations,
      array_to_string(list_sort(list_filter([{_CMP}], lambda w: contains(replace(lower(text), 'ß', 'ss'), w))), ' ') AS comparators FROM documents""",
    "tm_exact": r"""WITH d AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents),
      g AS (SELECT h, min(doc_id) AS first FROM d GROUP BY h HAVING count(*) > 1) SELECT doc_id, first FROM d JOIN g USING (h)""",
    "term_resolution": f"""SELECT lower(title) AS key, section_id AS target, ['USER', 'PAPER', 'PROJECT', 'DOMAIN', 'SYSTEM'][least(coalesce(level, 5), 5)] AS scope
      FROM (SELECT DISTINCT ON (section_id) * FROM sections) WHERE title IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY lower(title) ORDER BY least(coalesce(level, 5), 5), coalesce(confidence, 0) DESC, section_id) = 1""",
    "term_scan": f"""SELECT doc_id, term AS source, ((length(lower(text)) - length(replace(lower(text), lower(term), ''))) // length(term))::INT AS times
      FROM documents JOIN (VALUES {_TERM_VALUES}) t(term, target) ON contains(lower(text), lower(term))""",
    "glossary_drift": """WITH b AS (SELECT DISTINCT ON (block_id) block_id, paper_version_id, block_index, text FROM blocks ORDER BY block_id, ingested_at DESC NULLS LAST)
      SELECT a.block_id AS unit_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM b a JOIN b n ON n.paper_version_id = a.paper_version_id AND n.block_index = a.block_index + 1
      JOIN (VALUES ('calibration', 'decoder'), ('sparse', 'robust')) t(source, target) ON contains(lower(a.text), source) AND NOT contains(lower(coalesce(n.text, '')), target) GROUP BY 1""",
    "topic_alignment": rf"""WITH s AS (SELECT DISTINCT ON (section_id) * FROM sections), w AS (SELECT paper_version_id, list_distinct(flatten(list(regexp_extract_all(lower(title), '[\p{{L}}\p{{N}}_]+')))) AS words FROM s WHERE title IS NOT NULL GROUP BY 1 HAVING len(words) > 0),
      o AS (SELECT paper_id, version_id, words FROM {_V} JOIN w ON version_id = paper_version_id), f AS (SELECT paper_id, arg_min(words, version_id) AS base FROM o GROUP BY 1),
      j AS (SELECT version_id, round(len(list_intersect(words, base)) / len(list_distinct(list_concat(words, base))), 6) AS similarity FROM o JOIN f USING (paper_id))
      SELECT *, CASE WHEN similarity >= 0.35 THEN 'SAME' WHEN similarity >= 0.15 THEN 'RELATED' ELSE 'DIFFERENT' END AS relation FROM j""",
    "job_progress": f"SELECT job_id, round(least(1.0, sum({_W} * r)), 6) AS progress FROM (SELECT job_id, stage, max(ratio) AS r FROM {_STAGES} GROUP BY ALL) GROUP BY job_id",
    "job_stages": f"SELECT job_id, stage, min(ts) AS started, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 3) AS seconds FROM {_STAGES} GROUP BY ALL",
    "status_tally": f"SELECT paper_id, count_if(lower(parse_status) = 'parsed')::BIGINT AS parsed, count_if(lower(parse_status) = 'failed')::BIGINT AS failed, count_if(lower(parse_status) = 'pending')::BIGINT AS pending FROM {_V} GROUP BY paper_id",
    "history_last": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events QUALIFY rank <= 6",
    "event_windows": "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "supply_neighbours": """WITH e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem) SELECT node_id, count(*) AS degree FROM (SELECT a AS node_id, b FROM e UNION SELECT b, a FROM e) GROUP BY node_id""",
    "region_rollup": """SELECT r_name, c_mktsegment, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, c_mktsegment)""",
    "provider_near_years": r"""WITH p AS (SELECT DISTINCT ON (record_id) record_id, provider, year, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+'))), ' ') AS key FROM provider_records WHERE title IS NOT NULL),
      s AS (SELECT a.record_id, b.record_id AS other, round(0.85 + CASE WHEN a.year = b.year THEN 0.15 WHEN abs(a.year - b.year) = 1 THEN 0.075 ELSE 0 END, 4)::DOUBLE AS score FROM p a JOIN p b ON a.key = b.key AND a.provider != b.provider WHERE a.key != ''),
      r AS (SELECT *, row_number() OVER w AS k, coalesce(lead(score) OVER w, 0) AS second FROM s WINDOW w AS (PARTITION BY record_id ORDER BY score DESC, other))
      SELECT record_id, other AS best, score, CASE WHEN score >= 0.78 AND score - second < 0.08 THEN 'AMBIGUOUS' WHEN score >= 0.78 THEN 'PROBABLE' ELSE 'UNRESOLVED' END AS status FROM r WHERE k = 1""",
}
