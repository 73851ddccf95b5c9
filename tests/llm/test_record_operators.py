import pytest
from pyspark.sql import functions as F

from quire.llm import mixing, names, works

SAME = [
    {"Zoë Mokráperge", "Z. Mokráperge", "Mokráperge, Zoë", "Zoe Mokraperge", "zoë mokráperge", "Dr. Zoë Mokráperge", "Zoë M. Mokráperge*", "Zoë Mokrápergge"},
    {"William Trulimer", "Bill Trulimer", "B. Trulimer", "TRULIMER William", "Trulimer W"},
    {"Karl-Heinz Süturensu", "Karl-Heinz Sueturensu", "K-H, Süturensu"},
    {"Gideronne Institute of Pattern Analysis", "Gideronne Inst. Pattern Anal.", "Gideronne IPA", "Institute of Pattern Analysis, Gideronne", "The Gideronne Institute for Pattern Analysis (GIPA)"},
    {"Walter Trulimer"} - {"Walter Trulimer"} | {"Ursula Mokráperge"},
]


def test_names(spark):
    every = [n for s in SAME for n in sorted(s)]
    data = [(every[:9],), (every[9:] + ["et al.", "", None],), (None,), ([],), (every[:3],)]
    df = spark.createDataFrame(data, "authors array<string>").withColumn("name", F.lit("clash"))
    got = {tuple(r) for r in names.found(df).collect()}
    want = {(a, b) for s in SAME for a in s for b in s if a < b}
    assert got == want
    assert names.found(df.limit(0)).count() == 0


def test_one_typo_in_two_written_forms(spark):
    """A repeated slip links by its given name at any count; other given names never do; initials need lopsided counts."""
    one = {"J. Smiht", "Smiht, John", "John Smith", "J. Smith"}
    hot = {"Q. Tekobrleo", "Tekobrleo, Q.", "Quentin Tekobrelo", "Q. Tekobrelo", "Tekobrelo, Quentin", "Tekobrelo Q."}
    jan, jens = {"Jan Hansen", "Hansen, Jan"}, {"Jens Hanson", "Hanson, Jens"}
    meier, meyer = {"A. Meier", "Meier, A."}, {"A. Meyer", "Meyer, A."}
    groups = [one, hot, jan, jens, meier, meyer]
    df = spark.createDataFrame([(sorted(g),) for g in groups], "authors array<string>")
    assert {tuple(r) for r in names.found(df).collect()} == {(a, b) for s in groups for a in s for b in s if a < b}


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(f"n{i + j:03d}", f"f{i}") for i in range(60) for j in (0, 1)], "name string, form string")
    assert {r["entity"] for r in names.components(edges).collect()} == {"n000"}


def test_one_slip():
    assert names.one_slip("abcd", "abdc") and names.one_slip("abcd", "abd") and names.one_slip("abcd", "abxd") and names.one_slip("a", "a")
    assert not names.one_slip("abcd", "badc") and not names.one_slip("abcd", "ab")


R = "record_id long, provider string, title string, authors array<string>, year int"


def test_works(spark):
    a = ["Zoë Mokráperge", "Thomas Gekegorka"]
    data = [
        (1, "x", "Gozannet: Shallow Binarization for Iterative Scheduler Matching", a, 2019),
        (2, "y", "<i>GOZANNET SHALLOW BINARIZATION 4 ITERATIVE SCHEDULER MATCHING</i> [Preprint]", a, 2020),
        (3, "z", "Gozannet: Shalow Binarization for Iterative Scheduler Matching", None, 2019),
        (4, "y", "Beyond Gozannet: Shallow Binarization for Iterative Scheduler Matching", a, 2020),
        (5, "z", "Gozannet: Shallow Binarization for Iterative Scheduler Matching, Part II", a, 2020),
        (6, "x", "A Survey of Page Layout", ["Anna One"], 2010), (7, "y", "A Survey of Page Layout", ["Berta Two"], 2010), (8, "z", "A Survey of Page Layout", None, 2010),
        (9, "y", "Gozannet: Shallow Binarization for Iterative Scheduler Matching", a, 2025),
        (10, "x", None, a, 2019), (11, "x", "", None, None), (None, "x", "Gozannet", a, 2019), (12, None, "Gozannet: Shallow Binarization", a, 2019),
        (2, "y", "<i>GOZANNET SHALLOW BINARIZATION 4 ITERATIVE SCHEDULER MATCHING</i> [Preprint]", a, 2020),
    ]
    df = spark.createDataFrame(data, R).withColumn("kind", F.lit("clash"))
    got = {(r["record_id_a"], r["record_id_b"]): r["confidence"] for r in works.matched(df).collect()}
    assert set(got) == {(1, 2), (1, 3), (2, 3)}
    assert all(0 < c <= 1 for c in got.values())
    assert works.found(df.limit(0)).count() == 0


def test_works_with_slips_in_two_words(spark):
    """Slips in two words link without authors on one side, and in four words with them; links of links are followed to the end."""
    a = ["Zoë Mokráperge"]
    common = [(10 + i, "w", f"{t} Study {i}", [f"Nora Other{i}"], 2000) for i, t in enumerate(["Reliable Corpus", "Revision Alignment", "Benchmark Cache", "Reliable Prior"] * 3)]
    data = common + [
        (1, "x", "Gadovrank Reliable Corpus Convolutional Revision Alignment", a, 2020), (2, "y", "Gadovrank Reliable Coprus Convolutional Revison Alignment", None, 2020),
        (3, "x", "Measuring Benchmark Cache Reliable Prior Conditional", a, 2013), (4, "y", "Measuring Benchmrk Cahce Raliable Piror Conditional", a, 2013),
        (5, "x", "Sparse Tensor Kernels Layered Voxel Atlas Gadget Mirror", None, 2015), (6, "y", "Sparse Tensor Kernels Layered Voxel Atlas Gadget", None, 2015),
        (7, "z", "Sparse Tensor Kernels Layered Voxel Atlas", None, 2015), (8, "w", "Sparse Tensor Kernels Layered Voxel", None, 2015),
    ]
    got = {tuple(r) for r in works.found(spark.createDataFrame(data, R)).collect()}
    assert {(1, 2), (3, 4)} | {(i, j) for i in range(5, 9) for j in range(i + 1, 9)} == got


def test_works_by_tail_and_near_authors(spark):
    """A subtitle alone meets its whole title through an author; authors a slip apart count as common; singular and plural stay apart."""
    a = ["Nora Tekobrelo", "Jan Other"]
    data = [
        (1, "x", "Learning the Viewpoint Embedding: Auxiliary Column under Spectral Depth", a, 2009), (2, "y", "Auxiliary Column under Spectral Depth", a, 2009),
        (3, "x", "Gadovrank: Marginal Codebook for Curated Skew", ["Nora Gradudruno"], 2020), (4, "y", "Gadovrank: Marginal Codebook for Curated Skew", ["N. Gradudrunko"], 2020),
        (5, "x", "Spectral Captions and Smooth Ledgers in Probabilistic Caption", ["Eva Third"], 2019), (6, "y", "Spectral Captions and Ledgers in Probabilistic Caption", None, None),
        (7, "y", "Auxiliary Column under Spectral Depth", ["Paul Else"], 2001), (None, "z", "Auxiliary Column under Spectral Depth", a, 2009),
    ]
    df = spark.createDataFrame(data, R).withColumn("venue", F.lit("Journal of Tests")).withColumn("lost", F.lit("clash"))
    assert {tuple(r) for r in works.found(df).collect()} == {(1, 2), (3, 4), (5, 6)}


def test_entities_rarity(spark):
    df = spark.createDataFrame([(["Zoë Mokráperge", "Z. Mokráperge", "Mokráperge, Zoë", "Ursula Lone"],)], "authors array<string>")
    got = {r["name"]: (r["spellings"], r["rarity"]) for r in names.linked(df).collect()}
    assert got["Ursula Lone"] == (1, 1.0) and got["Z. Mokráperge"] == (3, round(1 / 3, 6)) and got["Zoë Mokráperge"] == (3, 0.5)


def test_hot_title(spark):
    """A generic title in a third of the rows links only what shares an author."""
    data = [(i, f"p{i % 3}", "An Overview of Tables", [f"Nora N{i // 3:03d}lastname"], 2010) for i in range(300)]
    got = works.found(spark.createDataFrame(data, R))
    assert got.count() <= 300 * 299 / 2 and works.title_words("An Overview of Tables")[1] == ["overview", "tables"]


@pytest.fixture(scope="module")
def mixed(spark):
    docs = [(i, "alpha " * 40 + f"- point {i}", "a") for i in range(60)] + [(100 + i, f"mod: beta {i} gamma\nreader1: delta", "b") for i in range(40)]
    docs += [(200, None, "a"), (201, "", "a"), (202, "mod: beta gamma\nreader1: delta", None), (203, "alpha alpha alpha", "other")]
    targets = [("a", 0.8, 1), ("b", 0.2, 3), ("gone", 0.1, 2)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("tokens", F.lit("clash"))
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return d, t, mixing.mixture(d, t)


def test_mixture(spark, mixed):
    d, t, m = mixed
    rows = m.collect()
    assert len(rows) == 103 and {r["home"] for r in rows} <= {"a", "b"}
    assert all(0 <= r["repeats"] <= {"a": 1, "b": 3}[r["home"]] for r in rows)
    got = {r["source"]: r for r in mixing.shares(d, t, mixed=m).collect()}
    assert abs(got["a"]["actual_share"] - 0.8 / 1.0) < 0.03 and got["gone"]["tokens"] == 0
    assert [r["home"] for r in rows if r["doc_id"] == 202] == ["b"]


def test_mixture_of_nothing(spark, mixed):
    d, t, _ = mixed
    assert mixing.mixture(d.limit(0), t).count() == 0
    assert all(r["repeats"] in (None, 0) for r in mixing.mixture(d.limit(2), t.limit(0)).collect())
