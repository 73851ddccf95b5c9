from pyspark.sql import functions as F

from quire.operators import probe, terms as M, translation as T
from quire.sources import providers


def test_translation_run(spark):
    units = spark.createDataFrame([(1, "d", 1, "The decoder [3] works."), (2, "d", 2, "Known text."), (3, "d", 3, "In 1998 it failed."), (4, "d", 4, None)], "unit_id int, doc_id string, place int, source_text string")
    memory = units.where("unit_id = 2").select(M.memory_key(F.col("source_text")).alias("source_hash"), F.lit("Bekannt.").alias("translation"), F.lit(1.0).alias("quality_score"))
    terms = spark.createDataFrame([("decoder", "Dekoder")], "source string, target string")
    ready = T.prepared(units, memory, terms)
    got = {r["unit_id"]: r for r in ready.collect()}
    assert "⟦CITE_000⟧" in got[1]["text"] and got[2]["translation"] == "Bekannt." and got[2]["before"].startswith("The decoder")
    answers = spark.createDataFrame([(1, "Der Dekoder ⟦CITE_000⟧ geht."), (3, "Es misslang.")], "unit_id int, answer string")
    done = {r["unit_id"]: r for r in T.verified(ready, answers).collect()}
    assert done[1]["status"] == "DONE" and done[1]["target_text"] == "Der Dekoder [3] geht." and done[2]["status"] == "DONE"
    assert done[3]["reasons"] == ["LOST_TOKEN"] and done[4]["status"] == "NEEDS_RETRY"
    assert T.repairs(T.verified(ready, answers)).count() == 2
    assert T.remembered(T.verified(ready, answers)).count() == 2


def test_probe_and_template(spark):
    pages = spark.createDataFrame([("a", 1, 3000, 0, 9, 0, [50.0, 300.0]), ("a", 2, 2500, 0, 0, 20, [50.0]), ("s", 1, 0, 1, 0, 0, None)], "doc_id string, page int, text_chars int, image_boxes int, table_lines int, formula_symbols int, x0s array<double>")
    rep = {r["doc_id"]: r for r in probe.report(pages).collect()}
    assert rep["a"]["kind"] == "BORN_DIGITAL" and rep["a"]["columns"] == 2 and rep["s"]["kind"] == "SCANNED"
    backends = spark.createDataFrame([("spans", "text", 2), ("words", "text", 1), ("grid", "tables", 1), ("vision", "ocr", 1)], "backend string, capability string, preference int")
    got = {(r["doc_id"], r["place"]): r["backend"] for r in probe.plan(probe.report(pages), backends).collect()}
    assert got[("a", 0)] == "spans" and got[("s", 0)] == "spans" and ("s", 2) in got
    prints = spark.createDataFrame([("a", 2, 612.0, 10.0, 12.0, [50.0, 306.0]), ("b", 1, 612.0, 10.0, 12.0, [50.0])], "doc_id string, columns int, width double, font double, line double, edges array<double>")
    reg = spark.createDataFrame([("two", 2, 610.0, 10.1, 12.5, [52.0, 300.0]), ("odd", 2, 400.0, 14.0, 30.0, [1.0])], "template string, columns int, width double, font double, line double, edges array<double>")
    assert [(r["doc_id"], r["template"], r["score"]) for r in probe.template(prints, reg).collect()] == [("a", "two", 5.0)]


def test_providers(spark):
    cross = '{"message":{"DOI":"10.1/X","title":["T"],"author":[{"given":"A","family":"B"},{"name":"Org"}],"issued":{"date-parts":[[2019,5]]},"container-title":["V"]}}'
    got = providers.crossref(spark.createDataFrame([(1, cross), (2, "no json"), (3, None)], "request_id int, body string")).orderBy("request_id").collect()
    assert got[0].asDict() == {"request_id": 1, "doi": "10.1/x", "title": "T", "authors": ["A B", "Org"], "year": 2019, "venue": "V"} and got[1]["doi"] is None
    feed = "<feed><entry><id>http://arxiv.org/abs/1234.56789v2</id><title>A\n B</title><author><name>X Y</name></author><published>2020-01-01</published></entry></feed>"
    assert providers.atom(spark.createDataFrame([(1, feed)], "request_id int, body string")).first().asDict() == {"request_id": 1, "arxiv_id": "1234.56789", "title": "A B", "authors": ["X Y"], "year": 2020}
    tei = "<TEI><titleStmt><title>T</title></titleStmt><head n='1'>Intro</head><biblStruct><a>R</a></biblStruct></TEI>"
    assert [r["kind"] for r in providers.tei(spark.createDataFrame([(1, tei)], "doc_id int, body string")).orderBy("confidence").collect()] == ["reference", "heading", "title"]
