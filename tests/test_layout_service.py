from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import evidence as E, geometry as G, layout as L, service as V
from quire.session import hash_sample, pairs_within


def test_number_values(spark):
    said = {"0.50": "0.5", "+3": "3", "−.5": "-0.5", "007": "7", "5.0%": "5%", "-0": "0", "1e3": "1000", "100": "100", "10.10 %": "10.1%"}
    df = spark.createDataFrame(list(said.items()), "a string, b string").withColumn("v", T.number_value(F.col("a")))
    assert all(r["v"] == r["b"] for r in df.collect())
    got = spark.createDataFrame([("at 9 12345.5% and 0.50, 0.5 or v2", )], "t string").select(T.numbers(F.col("t"))).first()[0]
    assert got == ["0.5", "12345.5%", "9"]


def test_guard(spark):
    excerpt = "It never fails. The rate is 0.50 here. Other parts rise."
    ledger = spark.createDataFrame([("e1", excerpt), ("e2", "同样 同样"), ("e3", None)], "evidence_id string, excerpt string")
    claims = [
        ("ok", "The rate is 0.5"), ("number", "The rate is 50%"), ("negation", "The rate is never 0.5"), ("zh", "该率 无需 调整"), ("comparison", "higher"),
        ("unknown", "x"), ("span", "x"), ("twice", "x"), ("moved", "The rate is 0.5"), ("none", "x"), ("null", None),
    ]
    quote, at = "The rate is 0.50", excerpt.index("The rate")
    own = [(c, "e1", quote, at, at + 16) for c in ("ok", "number", "negation", "zh", "comparison", "null")]
    links = own + [("unknown", "zz", quote, at, at + 16), ("span", "e1", quote, 5, 900), ("twice", "e2", "同样", 1, 3), ("moved", "e1", quote, 0, 16)]
    got = {r["claim_id"]: (r["accepted"], r["reasons"]) for r in E.guard(
        spark.createDataFrame(claims, "claim_id string, text string"), spark.createDataFrame(links, "claim_id string, evidence_id string, quote string, char_start int, char_end int"), ledger).collect()}
    assert got["ok"] == got["moved"] == got["null"] == (True, [])
    assert got["number"] == (False, ["NUMBER_NOT_IN_EVIDENCE:50%"]) and got["comparison"] == (False, ["COMPARISON_DIRECTION_UNSUPPORTED"])
    assert got["negation"] == got["zh"] == (False, ["NEGATION_CONTEXT_MISMATCH"])
    assert "UNKNOWN_EVIDENCE_ID" in got["unknown"][1] and "QUOTE_SPAN_OUT_OF_RANGE" in got["span"][1] and "QUOTE_NOT_UNIQUE_LITERAL_SUBSTRING" in got["twice"][1]
    assert got["none"] == (False, ["CLAIM_HAS_NO_VALID_EVIDENCE"])
    done = E.finalize(spark.createDataFrame([(k, *v) for k, v in got.items()], "claim_id string, accepted boolean, reasons array<string>"), spark.createDataFrame([("ok", "SUPPORTED"), ("moved", "REFUTED")], "claim_id string, verdict string"))
    end = {r["claim_id"]: r["reasons"] for r in done.collect()}
    assert end["ok"] == [] and end["moved"] == ["SEMANTIC_REFUTED"] and end["null"] == ["SEMANTIC_VERDICT_MISSING"]


def test_negations_longest_first(spark):
    got = spark.createDataFrame([("无需不用 not annotation",), (None,), ("",)], "t string").select(E.negations(F.col("t"))).collect()
    assert got[0][0] == ["not", "不用", "无需"] and got[2][0] == []


def test_grid_keeps_repeated_texts(spark):
    spans = [("t", 1.0, 1.0, 9.0, 5.0, "0.5"), ("t", 11.0, 1.0, 19.0, 5.0, "0.5"), ("t", 1.0, 11.0, 9.0, 15.0, "b"), ("t", 4.0, 11.0, 9.0, 15.0, "c"), ("t", 31.0, 11.0, 39.0, 15.0, "z"), ("u", 0.0, 0.0, 1.0, 1.0, None)]
    edges = [("t", [0.0, 10.0, 20.0], [0.0, 10.0, 20.0, 30.0, 40.0]), ("u", [], [0.0]), ("v", None, None)]
    got = G.grid(spark.createDataFrame(spans, "table_id string, x0 double, y0 double, x1 double, y1 double, text string"), spark.createDataFrame(edges, "table_id string, rows array<double>, columns array<double>"))
    assert {(r["row"], r["column"], r["text"]) for r in got.collect()} == {(0, 0, "0.5"), (0, 1, "0.5"), (1, 0, "b c"), (1, 2, "z")}


def test_pairs_within_splits_hot_keys(spark):
    rows = [("hot", i) for i in range(60)] + [("a", 1), ("a", 2), ("b", 9), (None, 3), ("c", None)]
    got = [tuple(r) for r in pairs_within(spark.createDataFrame(rows, "k string, v int"), "k", "v", block=7).collect()]
    want = {("hot", i, j) for j in range(60) for i in range(j)} | {("a", 1, 2)}
    assert len(got) == len(want) and set(got) == want


def test_hash_sample(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 2900, "big").when(F.col("id") < 2990, "small").otherwise("other").alias("g"))
    got = {r["g"]: r["n"] for r in hash_sample(df, "g", "id", ["big", "small"], 50, 3).groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert got == {"big": 50, "small": 50} and hash_sample(df.limit(0), "g", "id", ["big"], 5, 3).count() == 0


def test_text_signs(spark):
    df = spark.createDataFrame([("x^2 = y_1 + ∑",), ("no formula here at all",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(L.formula_like(F.col("t"))).collect()] == [True, False, False, False]
    assert [r[0] for r in df.select(L.first_sentence(F.col("t"))).collect()] == ["x^2 = y_1 + ∑", "no formula here at all", "", ""]
    names = spark.createDataFrame([("Smith, John",), ("Anna B. Meier",), ("",), (None,)], "n string")
    assert [r[0] for r in names.select(L.surname(F.col("n"))).collect()] == ["smith", "meier", "", ""]
    json = spark.createDataFrame([('```json\n{"a": 1}\n```',), ("no json",), (None,)], "t string").select(V.safe_json(F.col("t"), "$.a", "-"))
    assert [r[0] for r in json.collect()] == ["1", "-", "-"]


def test_pdf_files(spark):
    rows = [("a", bytearray(b"%PDF-1.7 x")), ("b", bytearray(b"hello")), ("c", None), ("d", bytearray(b""))]
    got = {r["path"]: r["problem"] for r in L.valid_pdf(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"a": None, "b": "NOT_PDF", "c": "EMPTY", "d": "EMPTY"}


def test_scoped_falls_back(spark):
    chunks = spark.createDataFrame([("c1", ["a"]), ("c2", ["b"]), ("c3", None)], "chunk_id string, block_ids array<string>")
    one, none = spark.createDataFrame([("a",)], "block_id string"), spark.createDataFrame([("z",)], "block_id string")
    assert [r["chunk_id"] for r in V.scoped(chunks, one).collect()] == ["c1"] and V.scoped(chunks, none).count() == 3
