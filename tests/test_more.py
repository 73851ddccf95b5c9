import datetime as dt

from pyspark.sql import functions as F

from quire.operators import compare as C, fusion, geometry, jobs, records as K, references as B, research as N
from quire.sources import html, sinks
from quire.sources.tables import latest
from quire.streaming import jobs as stream

PAGE = """<html><head><title>On  Things</title><script>if (a) document.write("</p><p>no")</script></head><body><h1>On Things</h1><span class="ltx_personname">A. Writer</span>
<p>First &amp; second <math alttext="x^2"></math> run<p>unclosed
<h2>Data</h2><div><p>Text.</p></div><table class="ltx_equation"><tr><td><math alttext="a=b"></math></td><td>(3)</td></tr></table>
<table><caption>cap</caption><tr><th>Model</th><th>Acc</th><th>F1</th></tr><tr><td rowspan=2>Ours</td><td>91.2</td><td>80 %</td></tr><tr><td>90.1</td></tr></table>
<ul><li class="ltx_bibitem">[1] A. Writer. A title of some length. 2019.</li></ul></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id long, html string")
    got = [(r["role"], r["section_path"], r["text"], r["formula_number"]) for r in html.blocks(pages).orderBy("pos").collect()]
    assert ("PARAGRAPH", "On Things > Data", "Text.", None) in got
    assert ("FORMULA", "On Things > Data", "$a=b$", "3") in got
    assert ("PARAGRAPH", "On Things", "First & second $x^2$ run", None) in got
    assert not any("document.write" in t for _, _, t, _ in got)
    t = html.tables(pages).first()
    assert t["rows"] == [["Model", "Acc", "F1"], ["Ours", "91.2", "80 %"], ["Ours", "90.1", ""]]
    assert html.bibliography(pages).first()["raw_text"].startswith("[1] A. Writer")
    assert html.metadata(pages).where("page_id = 1").first()["authors"] == ["A. Writer"]
    records = html.experiment_records(html.tables(pages).select(F.lit("t").alias("table_id"), "rows")).collect()
    assert ("Ours", "Acc", "91.2") in [(r["method"], r["metric"], r["value"]) for r in records]
    assert html.grid_csv([['a"b', "c\nd"]]) == '"a""b",c d\n'


def test_references(spark):
    text = "Body\nReferences\n[1] A. Writer and B. Other. A title of some length. Venue, 2019. doi:10.1234/ab.5.\n[3] “Another quoted title here”, arXiv:1234.56789, 2020\nAppendix\nx"
    body = spark.createDataFrame([("v", text)], "v string, text string").select("v", B.section(F.col("text")).alias("text"))
    refs = B.lint(B.parse(B.entries(body, "v", "text")), "v").orderBy("sequence_number").collect()
    assert [r["number"] for r in refs] == [1, 3]
    assert refs[0]["doi"] == "10.1234/ab.5" and refs[0]["year"] == 2019 and refs[0]["parsed_title"] == "A title of some length"
    assert refs[1]["arxiv_id"] == "1234.56789" and "NON_SEQUENTIAL_NUMBER" in refs[1]["format_issues"] and "NO_FINAL_PERIOD" in refs[1]["format_issues"]
    groups = spark.createDataFrame([("[3,5-8]",), ("[9-2]",), ("[1-99]",), ("[4]",)], "g string").select(B.expand_group(F.col("g")).alias("n")).collect()
    assert [r["n"] for r in groups] == [[3, 5, 6, 7, 8], [], [], [4]]
    refs = spark.createDataFrame([("r1", "10.1/x", None, "Sparse maps of pages", 2019, ["A. Writer"]), ("r2", None, None, "Sparse maps of pages", 2019, ["A. Writer"]), ("r3", None, None, "Nothing known", None, None)], "reference_id string, doi string, arxiv_id string, parsed_title string, year int, authors array<string>")
    prov = spark.createDataFrame([("p1", "10.1/X", None, "Sparse maps of pages", 2019, ["Writer, A."])], "identifier string, doi string, arxiv_id string, title string, year int, authors array<string>")
    got = {r["reference_id"]: r["identity_status"] for r in B.resolve(refs, prov).collect()}
    assert got == {"r1": "VERIFIED", "r2": "PROBABLE", "r3": "UNRESOLVED"}


def test_fusion(spark):
    schema = "candidate_id string, backend string, page int, kind string, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, confidence double"
    data = [("a", "p", 1, "text", "one two three four", (0.0, 0.0, 100.0, 10.0), 0.7), ("b", "q", 1, "text", "one two three fuor", (0.0, 1.0, 100.0, 11.0), 0.9), ("c", "q", 1, "text", "far away text here", (0.0, 300.0, 100.0, 310.0), 0.5), ("d", "q", 1, "text", "", None, 0.9)]
    got = {r["candidate_id"]: r["members"] for r in fusion.fused(spark.createDataFrame(data, schema)).collect()}
    assert got == {"b": 2, "c": 1}
    p = spark.createDataFrame([(1, "LOW", 10), (2, "GOOD", 10), (3, "LOW", 5)], "page int, verdict string, chars int")
    a = spark.createDataFrame([(1, "GOOD", 90), (2, "GOOD", 90), (3, "GOOD", 0), (4, "LOW", 4)], "page int, verdict string, chars int")
    assert {r["page"]: r["chosen"] for r in fusion.page_choice(p, a).collect()} == {1: "alternate", 2: "primary", 3: "primary", 4: "alternate"}


def test_geometry(spark):
    words = [("v", 1, x, y, x + 20, y + 10, t) for x, y, t in [(0, 0, "One"), (25, 1, "line"), (200, 0, "apart"), (0, 12, "next-"), (0, 24, "word."), (0, 60, "New")]]
    lines = geometry.lines(spark.createDataFrame([tuple(float(x) if isinstance(x, int) and i > 1 else x for i, x in enumerate(w)) for w in words], "paper_version_id string, page int, x0 double, y0 double, x1 double, y1 double, text string"))
    assert sorted(r["text"] for r in lines.collect()) == ["New", "One line", "apart", "next-", "word."]
    own = geometry.reading_order(lines.where("x0 < 100"))
    assert [r["text"] for r in geometry.paragraphs(own).orderBy("paragraph").collect()] == ["One line nextword.", "New"]
    assert geometry.merged_edges([1, 2, 10]) == [1.5, 10]


def test_records_and_jobs(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, K.append_new(old, new, "k").collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted(map(tuple, K.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert K.topological(["c", "a", "b", "x", "y"], [("a", "b"), ("x", "y"), ("y", "x")]) == ["b", "a", "c", "x", "y"]
    t = dt.datetime
    e = spark.createDataFrame([(1, "view", t(2024, 1, 1, 0, 0), 0.5), (1, "view", t(2024, 1, 1, 0, 1), 0.2), (1, "click", t(2024, 1, 1, 0, 2), 1.0)], "job_id int, stage string, ts timestamp, ratio double")
    assert jobs.progress(e, {"view": 0.4, "click": 0.2}).first()["progress"] == 0.4
    assert {r["stage"]: r["seconds"] for r in jobs.stages(e).collect()} == {"view": 60.0, "click": 0.0}
    dup = spark.createDataFrame([("a", 1, t(2024, 1, 1)), ("a", 2, t(2024, 1, 2)), ("b", 3, None), (None, 4, t(2024, 1, 1))], "id string, v int, ingested_at timestamp")
    assert {r["id"]: r["v"] for r in latest(dup, "id").collect()} == {"a": 2, "b": 3, None: 4}
    tools = {"read": lambda d: 1, "method": lambda d: 1 / 0, "experiments": lambda d: 2}
    tasks, needs = N.plan("METHOD")
    got = {k: v[0] for k, v in N.execute(tasks, needs, tools).items()}
    assert got == {"read": "DONE", "method": "FAILED", "experiments": "DONE", "limits": "SKIPPED", "report": "SKIPPED"}


def test_compare(spark):
    cells = spark.createDataFrame([("p1", "d", "x"), ("p2", "d", "x"), ("p3", "d", "y"), ("p1", "e", None)], "paper_id string, dimension string, value string")
    assert [tuple(r) for r in C.consensus(cells).collect()] == [("d", "x", 2, 3)]
    assert {r["dimension"]: r["missing"] for r in C.gaps(cells, 3).collect()} == {"d": 0, "e": 3}
    marks = spark.createDataFrame([("p", "a", 4), ("q", "a", 4), ("q", "b", 2)], "paper_id string, dimension string, score int")
    w = spark.createDataFrame([("a", 60), ("b", 40)], "dimension string, weight int")
    assert {r["paper_id"]: r["total"] for r in C.rubric(marks, w).collect()} == {"p": None, "q": 80.0}


def test_stream(spark, tmp_path):
    t = dt.datetime
    for i, (job, ratio) in enumerate([(1, 0.2), (1, 0.9), (2, 0.5)]):
        spark.createDataFrame([(job, "view", t(2024, 1, 1, i), ratio)], "job_id int, stage string, ts timestamp, ratio double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    seen = {}

    def sink(df, batch):
        for r in df.collect():
            seen[r["job_id"]] = max(seen.get(r["job_id"], 0), r["ratio"])

    state = stream.stage_state(stream.events(spark, str(tmp_path / "in"), schema), "2 days")
    stream.publish(state, str(tmp_path / "cp"), sink)
    assert seen == {1: 0.9, 2: 0.5}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert sinks.append_unseen(spark, rows, path, "k") == 2
    assert sinks.append_unseen(spark, rows, path, "k") == 0
    assert [r[0] for r in sinks.markdown_table(spark.createDataFrame([(1, "x|y")], "a int, b string"), ["a", "b"]).collect()] == ["| a | b |", "| --- | --- |", "| 1 | x\\|y |"]


def test_entry_contract():
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries()) and "bm25_documents" in E.queries()
