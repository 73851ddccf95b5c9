from pyspark.sql import functions as F

from quire.operators import evidence as E, terms as M


def test_guard(spark):
    text = "We cut the error by 12.5%. It does not improve recall. Recall is 40."
    ledger = spark.createDataFrame([("e1", text), ("e2", "same same"), ("e3", None)], "evidence_id string, excerpt string")
    claims = [
        ("good", "The error falls by 12.5%", "e1", "cut the error by 12.5%", 3, 25),
        ("moved", "The error falls by 12.5%", "e1", "cut the error by 12.5%", 0, 22),
        ("number", "The error falls by 13%", "e1", "cut the error by 12.5%", 3, 25),
        ("negated", "It never fails", "e1", "cut the error by 12.5%", 3, 25),
        ("unknown", "x", "zz", "x", 0, 1),
        ("range", "x", "e1", "x", 5, 4000),
        ("twice", "x", "e2", "same", 2, 6),
        ("null", "x", "e3", "x", 0, 1),
    ]
    df = spark.createDataFrame(claims, "claim_id string, text string, evidence_id string, quote string, char_start int, char_end int")
    got = {r["claim_id"]: (r["accepted"], r["reasons"]) for r in E.guard(df.select("claim_id", "text"), df.drop("text"), ledger).collect()}
    assert got["good"] == (True, []) and got["moved"] == (True, [])
    assert got["number"][1] == ["NUMBER_NOT_IN_EVIDENCE:13%"] and got["negated"][1] == ["NEGATION_CONTEXT_MISMATCH"]
    none = "CLAIM_HAS_NO_VALID_EVIDENCE"
    assert got["unknown"][1] == [none, "UNKNOWN_EVIDENCE_ID"] and got["range"][1] == [none, "QUOTE_SPAN_OUT_OF_RANGE"]
    assert got["twice"][1] == [none, "QUOTE_NOT_UNIQUE_LITERAL_SUBSTRING"] and got["null"][1] == [none, "UNKNOWN_EVIDENCE_ID"]


def test_negation_is_whole_word(spark):
    got = spark.createDataFrame([("annotation of novel notes",), ("Not without 没有",)], "t string").select(E.negations(F.col("t")).alias("n")).collect()
    assert got[0]["n"] == [] and got[1]["n"] == sorted(["not", "without", "没有"])


def test_terms(spark):
    terms = spark.createDataFrame(
        [("Decoder", "a", "SYSTEM", False, 0.9), ("decoder", "b", "USER", False, 0.1), ("mesh", "c", "PROJECT", False, 0.5), ("mesh", "d", "PROJECT", True, 0.1), (None, "x", "USER", False, 1.0)],
        "source string, target string, scope string, locked boolean, confidence double",
    )
    assert {r["key"]: r["target"] for r in M.resolve(terms).collect()} == {"decoder": "b", "mesh": "d"}


def test_memory(spark):
    memory = spark.createDataFrame([("a b  C",), ("one two three four five six",)], "normalized_source string").select(
        "normalized_source", M.memory_key(F.col("normalized_source")).alias("source_hash"), F.lit("t").alias("translation"), F.lit(1.0).alias("quality_score")
    )
    units = spark.createDataFrame([(1, "A B c"), (2, "one two three four five seven"), (3, "none of these")], "unit_id int, source_text string")
    assert {r["unit_id"]: r["translation"] for r in M.exact(units, memory).collect()} == {1: "t", 2: None, 3: None}
    near = {r["unit_id"]: r["similarity"] for r in M.fuzzy(units, memory).collect()}
    assert near[1] == 1.0 and abs(near[2] - 5 / 7) < 1e-6 and 3 not in near


def test_protect_round_trip(spark):
    texts = ["See [3, 5-8] and (Müller et al., 2019) in Fig. 3 with $a+b$ from 1998.", "", None, "no marks"]
    for t in texts:
        said, tokens = M.protect_text(t)
        assert M.restore_text(said, tokens) == t
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", M.protect(F.col("t")))
    back = df.withColumn("b", M.restore(F.col("p.text"), F.col("p.tokens"))).collect()
    assert all(r["b"] == r["t"] for r in back)


def test_drift_forms_no_pairs(spark):
    """A place with many sources and translations costs their sum, not their product, and each lost term counts once."""
    terms = spark.createDataFrame([("Sparse", "robust"), ("mesh", "Netz")], "source string, target string")
    hot = spark.range(300_000)
    sources = hot.select(F.concat(F.lit("h"), "id").alias("unit_id"), F.lit("v").alias("place"), F.lit("a SPARSE one").alias("source_text"))
    sources = sources.union(spark.createDataFrame([("kept", "w", "sparse mesh"), ("both", "x", "sparse mesh"), ("null", "y", "mesh"), ("alone", "z", "mesh"), ("no place", None, "mesh"), ("no text", "x", None)], "unit_id string, place string, source_text string"))
    targets = hot.select(F.lit("v").alias("place"), F.lit("Robust").alias("target_text")).union(spark.createDataFrame([("v", "weak")], "place string, target_text string"))
    targets = targets.union(spark.createDataFrame([("w", "robust netz"), ("x", "robust"), ("x", "netz"), ("y", None), (None, "none")], "place string, target_text string"))
    got = M.drift(sources, targets, terms, ["place"])
    assert got.where("unit_id like 'h%' and sources = array('Sparse')").count() == 300_000
    assert {r["unit_id"]: r["sources"] for r in got.where("unit_id not like 'h%'").collect()} == {"both": ["Sparse", "mesh"], "null": ["mesh"]}
