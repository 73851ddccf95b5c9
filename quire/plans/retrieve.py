"""Retrieval queries over documents, chunks and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import retrieval as R
from quire.sources.tables import table

ASKED = [(1, "sparse retrieval template confidence"), (2, "the learned calibration of the decoder calibration"), (3, "阈值 手稿 encoder")]
QUERY_VALUES = ", ".join(f"({i}, '{q}')" for i, q in ASKED)
CJK_SQL = "[㐀-鿿]"
TOKEN_SQL = r"[a-z]+(?:-[a-z0-9]+)+|[a-z][a-z0-9_]*|[-+]?[0-9]+(?:\.[0-9]+)?(?:e[-+]?[0-9]+)?%?|[㐀-鿿]"


def asked(spark):
    return spark.createDataFrame(ASKED, "query_id int, query string")


def tokens_sql(text: str) -> str:
    raw = f"regexp_extract_all(replace(lower({text}), 'ß', 'ss'), '{TOKEN_SQL}')"
    return (
        f"list_concat({raw}, list_transform(list_filter(range(1, greatest(len({raw}), 1)), lambda i: regexp_full_match({raw}[i], '{CJK_SQL}') "
        f"AND regexp_full_match({raw}[i + 1], '{CJK_SQL}')), lambda i: {raw}[i] || {raw}[i + 1]))"
    )


def bm25_sql(source: str, key: str, text: str, k: int, boost: str = "1.0", tokens=tokens_sql, least: str = "1e-300", p: str = "") -> str:
    """CTEs up to ``ranked``: every query's best units."""
    return f"""
    {p}queries(query_id, query) AS (VALUES {QUERY_VALUES}),
    {p}asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tokens('query')}) AS term FROM {p}queries) GROUP BY ALL),
    {p}units AS MATERIALIZED (SELECT {key}, {boost} AS boost, {tokens(text)} AS t FROM {source} WHERE {text} IS NOT NULL),
    {p}totals AS (SELECT count(*) AS n, CASE WHEN avg(len(t)) > 0 THEN greatest(avg(len(t)), {least}) ELSE 1.0 END AS a FROM {p}units),
    {p}tf AS (SELECT {key}, boost, length, term, count(*) AS tf FROM (SELECT {key}, boost, len(t) AS length, unnest(t) AS term FROM {p}units)
      WHERE term IN (SELECT term FROM {p}asked) GROUP BY ALL),
    {p}df AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY term),
    {p}scored AS (SELECT query_id, {key}, round(boost * sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / a))), 6) AS score
      FROM {p}tf JOIN {p}asked USING (term) JOIN {p}df USING (term) CROSS JOIN {p}totals GROUP BY query_id, {key}, boost),
    {p}ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {key}) AS rank FROM {p}scored WHERE score > 0 QUALIFY rank <= {k})"""


def bm25_documents(spark, root):
    return R.bm25(table(spark, root, "documents", "doc_id", "text"), asked(spark), "doc_id", "text", 8)


def lexical_bm25(spark, root):
    return R.lexical(table(spark, root, "documents", "doc_id", "text"), asked(spark), "doc_id", "text", 8)


def plain_sql(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')"


def bm25_section_boost(spark, root):
    chunks = table(spark, root, "chunks", "chunk_id", "section_path", "text").dropDuplicates(["chunk_id"])
    hint = F.lower(F.coalesce("section_path", F.lit("")))
    boost = F.when(hint.contains("method") | hint.contains("analysis"), 1.08).otherwise(1.0)
    return R.bm25(chunks, asked(spark), "chunk_id", "text", 8, boost=boost)


def multi_query_topk(spark, root):
    hits = R.bm25(table(spark, root, "documents", "doc_id", "text"), asked(spark), "doc_id", "text", 3)
    return hits.groupBy("doc_id").agg(F.max("score").alias("score"), F.min("rank").alias("rank"), F.count("*").alias("queries"))


def _two_lists(spark, root, k):
    docs = table(spark, root, "documents", "doc_id", "text")
    one = asked(spark).where("query_id = 1")
    a = R.bm25(docs, one, "doc_id", "text", k).select(F.lit("ranked").alias("source"), "doc_id", "rank")
    b = R.lexical(docs, one, "doc_id", "text", k).select(F.lit("lexical").alias("source"), "doc_id", "rank")
    return a.unionByName(b)


def rrf_fusion(spark, root):
    return R.fuse(_two_lists(spark, root, 20), "doc_id", 10).select("doc_id", "score", "rank")


def _probe(spark, root):
    return spark.read.parquet(f"{root}/embeddings.parquet").where("vec_id = 1").select("embedding").first()[0]


def dense_topk(spark, root):
    return R.dense(table(spark, root, "embeddings"), _probe(spark, root), "vec_id", "embedding", 10)


def hybrid_search(spark, root):
    dense = R.dense(table(spark, root, "embeddings"), _probe(spark, root), "vec_id", "embedding", 20)
    lists = _two_lists(spark, root, 20).unionByName(dense.select(F.lit("dense").alias("source"), F.col("vec_id").alias("doc_id"), "rank"))
    return R.fuse(lists, "doc_id", 10).select("doc_id", "score", "rank", F.array_join("sources", ",").alias("sources"))


def retrieval_sufficiency(spark, root):
    docs = table(spark, root, "documents", "doc_id", "text")
    return R.sufficient(R.bm25(docs, asked(spark), "doc_id", "text", 8), docs, asked(spark), "doc_id", "text")


_COSINE = "round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 5)"
_DENSE = f"""probe AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 1 LIMIT 1),
    dense AS (SELECT vec_id, {_COSINE} AS score, row_number() OVER (ORDER BY {_COSINE} DESC, vec_id) AS rank FROM embeddings CROSS JOIN probe)"""


_A = bm25_sql("documents", "doc_id", "text", 20, p="ra_")
_B = bm25_sql("documents", "doc_id", "text", 20, tokens=plain_sql, least="1.0", p="rb_")
_LISTS = f"""lists AS (SELECT 'ranked' AS source, doc_id, rank FROM ra_ranked WHERE query_id = 1 UNION ALL SELECT 'lexical', doc_id, rank FROM rb_ranked WHERE query_id = 1"""
_FUSE = """SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank{more} FROM
    (SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM lists GROUP BY doc_id)
    QUALIFY rank <= 10"""
_USEFUL = "list_distinct(list_filter({t}, lambda x: length(x) > 1 OR regexp_full_match(x, '[0-9]')))"

QUERIES = {
    "bm25_documents": bm25_documents, "lexical_bm25": lexical_bm25, "bm25_section_boost": bm25_section_boost,
    "multi_query_topk": multi_query_topk, "rrf_fusion": rrf_fusion, "dense_topk": dense_topk, "hybrid_search": hybrid_search,
    "retrieval_sufficiency": retrieval_sufficiency,
}
SQL = {
    "bm25_documents": f"WITH {bm25_sql('documents', 'doc_id', 'text', 8)} SELECT query_id, doc_id, score, rank FROM ranked",
    "lexical_bm25": f"WITH {bm25_sql('documents', 'doc_id', 'text', 8, tokens=plain_sql, least='1.0')} SELECT query_id, doc_id, score, rank FROM ranked",
    "bm25_section_boost": "WITH "
    + bm25_sql(
        "(SELECT DISTINCT ON (chunk_id) chunk_id, section_path, text FROM chunks)", "chunk_id", "text", 8,
        boost="CASE WHEN lower(coalesce(section_path, '')) LIKE '%method%' OR lower(coalesce(section_path, '')) LIKE '%analysis%' THEN 1.08 ELSE 1.0 END",
    )
    + " SELECT query_id, chunk_id, score, rank FROM ranked",
    "multi_query_topk": f"WITH {bm25_sql('documents', 'doc_id', 'text', 3)} SELECT doc_id, max(score) AS score, min(rank) AS rank, count(*) AS queries FROM ranked GROUP BY doc_id",
    "rrf_fusion": f"WITH {_A}, {_B}, {_LISTS}) {_FUSE.format(more='')}",
    "dense_topk": f"WITH {_DENSE} SELECT vec_id, score, rank FROM dense WHERE rank <= 10",
    "hybrid_search": f"WITH {_A}, {_B}, {_DENSE}, {_LISTS} UNION ALL SELECT 'dense', vec_id, rank FROM dense WHERE rank <= 20) {_FUSE.format(more=', sources')}",
    "retrieval_sufficiency": f"""WITH {bm25_sql('documents', 'doc_id', 'text', 8)},
    useful AS (SELECT query_id, {_USEFUL.format(t=tokens_sql('query'))} AS asked FROM queries),
    good AS (SELECT query_id, bool_or(len(asked) > 0 AND len(list_intersect(asked, {_USEFUL.format(t=tokens_sql('text'))})) >= least(2, len(asked))) AS ok
      FROM ranked JOIN documents USING (doc_id) JOIN useful USING (query_id) WHERE rank <= 5 GROUP BY query_id)
    SELECT query_id, coalesce(ok, false) AS is_sufficient FROM queries LEFT JOIN good USING (query_id)""",
}
