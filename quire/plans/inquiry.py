"""Queries on questions, domains, revisions and content identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import references as B, research as N
from quire.plans.document import _ONE, blocks
from quire.sources.tables import table

MARKS = {"limit": ["despite", "whenever", "rarely"], "claim": ["outperforms", "beats", "exceeds"], "open": ["remains open", "hypothesize"]}


def route_questions(spark, root):
    q = table(spark, root, "eval_items", "item_id", "question").where("question is not null")
    return q.select("item_id", N.depth(F.col("question")).alias("depth"), N.intent(F.col("question")).alias("intent"))


def domain_tags(spark, root):
    return table(spark, root, "documents", "doc_id", "text").select("doc_id", F.array_join(N.domains(F.col("text")), ",").alias("domains"))


def revision_chain(spark, root):
    return N.revisions(table(spark, root, "blocks", "block_id", "text", "ingested_at"), "block_id", "text", "ingested_at")


def profile_sentences(spark, root):
    return N.profile_sentences(blocks(spark, root), MARKS)


def heading_candidates(spark, root):
    s = N.heading_score()
    return blocks(spark, root).select("block_id", s.alias("score")).where("score >= 0.66")


def content_identity(spark, root):
    """Whether the stored hash is that of the text; null hashes are left open."""
    b = table(spark, root, "blocks", "block_id", "text", "content_sha256").distinct()
    return b.select("block_id", (F.sha2("text", 256) == F.col("content_sha256")).alias("is_same")).groupBy("is_same").agg(F.count("*").alias("blocks"))


def citation_numbers(spark, root):
    """Every number of the citation groups of each block, groups and ranges expanded."""
    b = blocks(spark, root).select("block_id", F.explode(F.regexp_extract_all("text", F.lit(r"(\[[0-9]+(?:\s*[,–—-]\s*[0-9]+)*\])"), 1)).alias("raw"))
    return b.select("block_id", F.explode(B.expand_group(F.col("raw"))).alias("number")).groupBy("number").agg(F.count("*").alias("times"))


def record_ids(spark, root):
    """Identifiers of provider records in their canonical form."""
    p = table(spark, root, "provider_records", "record_id", "doi", "arxiv_id").distinct()
    return p.select("record_id", B.doi(F.col("doi")).alias("doi"), B.arxiv_id(F.col("arxiv_id")).alias("arxiv_id"))


def sentence_counts(spark, root):
    return table(spark, root, "documents", "doc_id", "text").select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"))


QUERIES = {f.__name__: f for f in (route_questions, domain_tags, revision_chain, profile_sentences, heading_candidates, content_identity, citation_numbers, record_ids, sentence_counts)}

_Q = r"trim(regexp_replace(lower(question), '\s+', ' ', 'g'))"
_any = lambda words: "(" + " OR ".join(f"contains({_Q}, '{w}')" for w in words) + ")"
_INTENT = " ".join(f"WHEN {_any(w)} THEN '{n}'" for n, w in N.INTENTS)
_DOMAIN = ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{n}' END" for n, p in sorted(N.DOMAINS))
_SENT = r"list_filter(string_split(regexp_replace(text, '([.!?。！？])\s+([A-Z\"''“‘一-鿿])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: true)"
_MARK = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(sentence), '{w}')" for w in words) + f" THEN '{n}' END" for n, words in MARKS.items())
_FIT = r"len(regexp_split_to_array(trim(text), '\s+')) <= 12 AND NOT regexp_matches(trim(text), '[.;,]$') AND length(trim(text)) > 1"
SQL = {
    "route_questions": f"SELECT item_id, CASE WHEN {_any(N.DEEP)} THEN 'DEEP' WHEN {_any(N.ANALYTIC)} OR length({_Q}) > 80 THEN 'ANALYTIC' ELSE 'QUICK' END AS depth, CASE {_INTENT} ELSE 'GENERAL' END AS intent FROM eval_items WHERE question IS NOT NULL",
    "domain_tags": f"SELECT doc_id, array_to_string(list_filter([{_DOMAIN}], lambda x: x IS NOT NULL), ',') AS domains FROM documents",
    "revision_chain": """WITH f AS (SELECT block_id AS node_id, left(sha256(coalesce(text, '')), 16) AS content_hash, min(ingested_at) AS since FROM blocks GROUP BY 1, 2)
      SELECT node_id, row_number() OVER w AS revision, content_hash, lag(content_hash) OVER w AS supersedes, CASE WHEN lead(content_hash) OVER w IS NULL THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status
      FROM f WINDOW w AS (PARTITION BY node_id ORDER BY since NULLS FIRST, content_hash)""",
    "profile_sentences": f"""WITH s AS (SELECT paper_version_id, page, block_index, unnest({_SENT}) AS sentence, generate_subscripts({_SENT}, 1) AS k FROM {_ONE} WHERE block_type = 'TEXT'),
      e AS (SELECT *, unnest(list_filter([{_MARK}], lambda x: x IS NOT NULL)) AS field FROM s)
      SELECT paper_version_id, field, row_number() OVER (PARTITION BY paper_version_id, field ORDER BY page, block_index, k) AS place, sentence FROM e QUALIFY place <= 5""",
    "heading_candidates": rf"""SELECT block_id, CASE WHEN {_FIT} THEN round(least(0.99, 0.48 + 0.18 * regexp_matches(trim(text), '^\s*[0-9]+(?:\.[0-9]+){{0,3}}[.)]?\s+\S')::INT
      + 0.18 * (coalesce(font_size, 0) > 10.8)::INT + 0.12 * coalesce(is_bold, false)::INT
      + 0.08 * regexp_matches(lower(trim(text)), '(?:abstract|introduction|references|conclusion|acknowledg|appendix|limitations|discussion)')::INT), 2)::DOUBLE ELSE 0 END AS score FROM {_ONE} WHERE score >= 0.66""",
    "content_identity": "SELECT is_same, count(*) AS blocks FROM (SELECT block_id, sha256(text) = content_sha256 AS is_same FROM (SELECT DISTINCT block_id, text, content_sha256 FROM blocks)) GROUP BY is_same",
    "citation_numbers": rf"""WITH g AS (SELECT unnest(regexp_extract_all(text, '\[[0-9]+(?:\s*[,–—-]\s*[0-9]+)*\]')) AS raw FROM {_ONE}),
      p AS (SELECT unnest(regexp_extract_all(translate(raw, '–—−', '---'), '[0-9]+(?:\s*-\s*[0-9]+)?')) AS p FROM g),
      r AS (SELECT regexp_extract(p, '^([0-9]+)', 1)::INT AS a, regexp_extract(p, '([0-9]+)$', 1)::INT AS b FROM p)
      SELECT number, count(*) AS times FROM (SELECT unnest(range(a, b + 1))::INT AS number FROM r WHERE b >= a AND b - a < 50) GROUP BY number""",
    "record_ids": r"""SELECT DISTINCT record_id, nullif(regexp_replace(regexp_extract(lower(doi), '\b(10\.[0-9]{4,9}/[^\s"<>]+)', 1), '[.,;:)\]}]+$', ''), '') AS doi,
      nullif(regexp_extract(arxiv_id, '^\s*([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?)\s*$', 1), '') AS arxiv_id FROM provider_records""",
    "sentence_counts": f"SELECT doc_id, len({_SENT}) AS sentences FROM documents",
}
