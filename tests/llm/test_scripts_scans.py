import pytest
from pyspark.sql import functions as F

from quire.llm import automaton, scans, scripts

B = "block_id string, paper_version_id string, page int, block_index int, block_type string, text string, ingested_at timestamp"


@pytest.mark.parametrize(
    "said, plain",
    [
        ("Тhе оpen dооr", "The open door"), ("Ρaper οf Αny", "Paper of Any"), ("ｗｉｄｅ－text．", "wide-text."), ("ﬁne ﬂow", "fine flow"),
        ("𝗯𝗼𝗹𝗱 text", "bold text"), ("Móndara", "Móndara"), ("a b c　d", "a b c d"), ("in​vi﻿sible­", "invisible"),
        ("рaсчeт в строке", "расчет в строке"), ("An а unstable map", "An a unstable map"),
    ],
)
def test_canonical(said, plain):
    assert scripts.canonical(said) == plain
    assert scripts.canonical(plain) == plain


@pytest.mark.parametrize("text", ["Здесь слово написано", "L = λ x + α", "the Greek β here", "样本，在没有。", "word Привет inside", "café naïve", "", "cut-\nword", "invar¬\niant"])
def test_left_alone(text):
    assert scripts.canonical(text) == text


def test_found_and_edges(spark):
    long = "plain words " * 50_000
    blocks = spark.createDataFrame([("b1", "Тhe"), ("b1", "Тhe"), ("b2", "The"), ("b3", None), ("b4", ""), (None, "Тhe"), ("b5", long + "​")], "block_id string, text string").withColumn("record_id", F.lit("clash"))
    sections = spark.createDataFrame([("s1", "Νetwork"), ("s2", None)], "section_id string, title string")
    assert sorted(tuple(r) for r in scripts.found(blocks, sections).collect()) == [("block", "b1"), ("block", "b5"), ("section", "s1")]
    assert scripts.found(blocks.limit(0), sections.limit(0)).count() == 0
    got = {(r["block_id"], r["text"]): r["is_changed"] for r in scripts.consistent(blocks.where("length(text) < 100 or text is null"), "text").collect()}
    assert got[("b3", None)] is False and got[("b4", "")] is False and got[("b1", "Тhe")] is True


def brute(words, token, bound):
    """All ways of applying confusions left to right."""
    out = {}

    def go(i, made, cost):
        if cost > bound:
            return
        if i == len(token):
            if made in words:
                out[made] = min(cost, out.get(made, 99))
            return
        go(i + 1, made + token[i], cost)
        for k, (read, printed) in enumerate(automaton.CONFUSIONS):
            if token.startswith(read, i):
                go(i + len(read), made + printed, cost + (automaton.STEP if k < automaton.COMMON else automaton.RARE_STEP))

    go(0, "", 0)
    return out


@pytest.mark.parametrize("token", ["rnargin", "cleterrninistic", "fhrcshold", "illiimination", "m0dern", "kemel", "vievvpoint", "outher", "plain"])
def test_automaton_is_complete(token):
    words = {"margin", "deterministic", "threshold", "illumination", "modern", "kernel", "viewpoint", "outlier", "plain", "pain"}
    assert automaton.search(automaton.trie(words), token, 6) == brute(words, token, 6)


def test_plain_edits():
    words = ["margin", "merging", "marginal"]
    assert set(automaton.search(automaton.trie(words), "margim", automaton.PLAIN_STEP, plain=True)) == {"margin"}
    assert set(automaton.search(automaton.trie(words), "argin", automaton.PLAIN_STEP, plain=True)) == {"margin"}


def page(spark):
    body = "the margin of the threshold outperforms the deterministic decoder in cross-modal pages and fine-grained columns"
    data = [(f"n{i}", "v0", 1 + i // 30, i, "TEXT", body, None) for i in range(60)]
    data += [
        ("b1", "v1", 1, 0, "TEXT", "The rnargin of the thresh-\nold is low- and high-resolution in cross-\nmodal pages.", None),
        ("b2", "v1", 1, 1, "TEXT", "Lett. Image Text 12 (5) - 1 -\nThe decoder outper-", None),
        ("b3", "v1", 2, 2, "TEXT", "On Dense Samplers and Columns", None),
        ("b4", "v1", 2, 3, "TEXT", "forms the margin.\n[2]", None),
        ("b5", "v1", 3, 4, "TEXT", "3/14", None),
        ("b6", "v1", 3, 5, "TEXT", None, None),
        ("b7", "v1", 3, 6, "TEXT", "", None),
        ("b5", "v1", 3, 4, "TEXT", "3/14", None),
    ]
    return spark.createDataFrame(data, B).withColumn("plain", F.lit("clash")).withColumn("kind", F.lit(1))


def test_noise_found(spark):
    got = {tuple(r) for r in scans.found(page(spark)).collect()}
    assert {("b1", "misread"), ("b1", "hyphen"), ("b2", "furniture"), ("b2", "hyphen"), ("b3", "furniture"), ("b4", "furniture"), ("b5", "furniture")} == got
    assert scans.found(page(spark).limit(0)).count() == 0


def test_paragraphs(spark):
    got = {r["block_id"]: r["paragraph"] for r in scans.paragraphs(page(spark).where("paper_version_id = 'v1' or page = 1")).collect()}
    assert got["b1"].startswith("The margin of the threshold is low- and high-resolution")
    assert got["b2"] == "The decoder outperforms" and got["b4"] == "the margin."
    assert "b3" not in got and "b5" not in got and "b6" not in got and "b7" not in got


def test_misread_below_the_ratio(spark):
    """Context makes a misread where counts do not; names that only look alike stay."""
    data = [(f"g{i}", f"Higrivingro et al. report number {i} plainly") for i in range(3)]
    data += [(f"l{i}", f"Sample {i} shows that learning the parser label is easy") for i in range(4)]
    data += [(f"m{i}", f"Bafenflow beats entry {i} in speed") for i in range(3)]
    data += [("x1", "Hlgrivingro et al. disagree"), ("x2", "Topics: learnmg the parser label"), ("x3", "Hafenflow loses to nothing")]
    data = [(i, "v", 1, n, "TEXT", t, None) for n, (i, t) in enumerate(data)]
    blocks = spark.createDataFrame(data, B)
    assert {r["block_id"] for r in scans.found(blocks).where("kind = 'misread'").collect()} == {"x1", "x2"}
    got = {r["block_id"]: r["paragraph"] for r in scans.paragraphs(blocks).collect()}
    assert got["x1"] == "Higrivingro et al. disagree" and got["x2"] == "Topics: learning the parser label" and got["x3"] == "Hafenflow loses to nothing"


def test_reach_covers_every_move():
    """Two moves of three letters to one fit the bound, so words four letters shorter are candidates."""
    assert automaton.reach(6) == (4, 3) and "amama" in automaton.search(automaton.trie(["amama"]), "arriarria", 6)


def test_cut_across_many_blocks(spark):
    """A word cut at a block end finds its rest behind any number of figures; text between ends the search."""
    rows = [("a", "v", 1, 1, "TEXT", "the first half of a seg-", None)] + [(f"f{i}", "v", 1, 1 + i, "FIGURE", "Figure", None) for i in range(1, 30)] + [("b", "v", 2, 31, "TEXT", "mentation is here.", None)]
    rows += [("c", "w", 1, 1, "TEXT", "another half of a seg-", None)] + [(f"t{i}", "w", 1, 1 + i, "TEXT", "Whole text.", None) for i in range(1, 9)] + [("d", "w", 2, 10, "TEXT", "mentation is here.", None)]
    got = {r["block_id"]: r["paragraph"] for r in scans.paragraphs(spark.createDataFrame(rows, B)).collect()}
    assert got["a"] == "the first half of a segmentation" and got["b"] == "is here." and got["d"] == "mentation is here."


def test_edits_from_both_ends():
    """The two half walks find what the whole walk with ordinary edits finds, wherever the edit lies."""
    words = ["retrieval", "retrievals", "modern", "margin", "margins", "merging", "kernel", "deterministic", "threshold", "plain"]
    ahead, back = automaton.trie(words), automaton.trie(w[::-1] for w in words)
    tokens = ["retreval", "etrieval", "retrievalx", "xretrieval", "retriewal", "rnargjn", "maring", "pla1n", "kerncl", "cletcrminjstic", "thresho", "x"]
    for token in tokens + [w[:i] + c + w[j:] for w in ("margin", "threshold") for i in range(len(w) + 1) for j in (i, i + 1) for c in ("", "x")]:
        for bound in (4, 6, 8):
            assert automaton.edited(ahead, back, token, bound) == automaton.search(ahead, token, bound, plain=True), (token, bound)
    assert automaton.edited(ahead, back, "retreval", 6)["retrieval"] == automaton.PLAIN_STEP
    assert automaton.reach(6, plain=True) == (4, 3) and automaton.reach(4, plain=True)[1] >= 1


def test_misread_by_an_ordinary_edit(spark):
    """An edit that no confusion explains is a misread where both sides say so; a right word one edit away is none."""
    rows = [(f"r{i}", f"we study the dense retrieval module for passages in part {i}") for i in range(45)]
    rows += [("x1", "we study the dense retreval module for passages again"), ("x2", "here the dense retrievel module for passages ends")]
    rows += [("s1", "many retrievals were timed"), ("s2", "the dense retrievals module for passages"), ("s3", "some retrievals were lost there"), ("s4", "both retrievals failed early on")]
    rows += [("d1", "we study the dense retrieval4 module for passages"), ("w1", "retrival")]
    blocks = spark.createDataFrame([(i, "v", 1, n, "TEXT", t, None) for n, (i, t) in enumerate(rows)], B)
    assert {r["block_id"] for r in scans.found(blocks).where("kind = 'misread'").collect()} == {"x1", "x2"}
    got = {r["block_id"]: r["paragraph"] for r in scans.paragraphs(blocks).collect()}
    assert got["x1"] == "we study the dense retrieval module for passages again" and got["x2"] == "here the dense retrieval module for passages ends"
    assert "retrievals" in got["s2"] and got["w1"] == "retrival" and "retrieval4" in got["d1"]
