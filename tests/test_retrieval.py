import math
from collections import Counter

import pytest

from quire.operators import retrieval as R


def brute(docs, query, k):
    toks = {i: t.split() for i, t in docs.items()}
    n, avg = len(docs), sum(map(len, toks.values())) / max(1, len(docs))
    df = Counter(w for t in toks.values() for w in set(t))
    out = []
    for i, t in toks.items():
        tf = Counter(t)
        s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query.split() if tf[w])
        if s > 0:
            out.append((-round(s, 6), i))
    return [(i, r + 1) for r, (_, i) in enumerate(sorted(out)[:k])]


DOCS = {1: "sparse retrieval of pages", 2: "dense retrieval retrieval", 3: "page layout", 4: "sparse sparse layout", 5: "nothing here"}


@pytest.mark.parametrize("query", ["sparse retrieval", "layout", "sparse sparse page", "absent"])
def test_bm25_equals_brute_force(spark, query):
    corpus = spark.createDataFrame(list(DOCS.items()) + [(6, None)], "id int, text string")
    got = R.bm25(corpus, spark.createDataFrame([(1, query)], "query_id int, query string"), "id", "text", 3)
    assert sorted((r["id"], r["rank"]) for r in got.collect()) == sorted(brute(DOCS, query, 3))


def test_empty_corpus_and_query(spark):
    corpus = spark.createDataFrame(list(DOCS.items()), "id int, text string")
    q = spark.createDataFrame([(1, "")], "query_id int, query string")
    assert R.bm25(corpus, q, "id", "text", 3).count() == 0
    assert R.bm25(corpus.limit(0), spark.createDataFrame([(1, "sparse")], q.schema), "id", "text", 3).count() == 0


def test_cjk_bigrams(spark):
    from quire.functions.text import rank_tokens
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("网络结构 v2",), ("Straße well-known -3.5%",), ("",)], "t string").select(rank_tokens(F.col("t")).alias("k")).collect()
    assert sorted(got[0]["k"]) == sorted(["网", "络", "结", "构", "v2", "网络", "络结", "结构"])
    assert got[1]["k"] == ["strasse", "well-known", "-3.5%"] and got[2]["k"] == []


def test_fusion_and_dense(spark):
    lists = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 3, 1), ("b", 1, 2)], "source string, id int, rank int")
    got = R.fuse(lists, "id", 3).orderBy("rank").collect()
    assert got[0]["id"] == 1 and got[0]["sources"] == ["a", "b"]
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "id int, e array<float>")
    assert [r["id"] for r in R.dense(vectors, [2.0, 0.0], "id", "e", 3).orderBy("rank").collect()] == [1, 3, 2]
