import pandas as pd
from pyspark.sql import functions as F

from quire.operators import structure as S


def test_canonical_sections(spark):
    titles = ["1 Introduction", "Training-free method", "Ablation Study", "B. Related Work", "Fine-tuning the head", "引言", "Zoo", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in titles], "t string").select(S.canonical_section(F.col("t"))).collect()]
    assert got == ["introduction", "method", "experiments", "related_work", "method", "introduction", None, None]


def test_packing():
    pdf = pd.DataFrame({"tokens": [300, 200, 100, 640, 30, 5], "section_id": list("aaaabb")})
    assert S.pack(pdf, 420, 650) == [0, 0, 1, 2, 3, 3]


def test_page_gate(spark):
    schema = "block_id string, paper_version_id string, page int, block_index int, block_type string, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>"
    body = "A sentence long enough to stand on a page of its own without any doubt. " * 3
    data = [(f"b{i}", "v", 1, i, "TEXT", body, (50.0, 20.0 * i, 400.0, 20.0 * i + 15)) for i in range(5)]
    data += [(f"c{i}", "v", 2, i, "TEXT", t, (50.0, 20.0 * i, 400.0, 20.0 * i + 15)) for i, t in enumerate([body, "x", "81.2 44 9.1"])]
    got = {r["page"]: r for r in S.page_gate(spark.createDataFrame(data, schema)).collect()}
    assert got[1]["verdict"] == "GOOD" and got[2]["verdict"] == "LOW"
    assert got[2]["contaminated"] == 1 and got[2]["tiny_ratio"] == 0.3333
    assert S.page_gate(spark.createDataFrame([], schema)).count() == 0


def test_table_runs(spark):
    kinds = ["CAPTION", "TABLE_ROW", "TABLE_ROW", "TEXT", "TABLE_ROW", "CAPTION"]
    data = [("v", 1, i, k, f"{k}{i}") for i, k in enumerate(kinds)]
    got = S.table_runs(spark.createDataFrame(data, "paper_version_id string, page int, block_index int, block_type string, text string")).orderBy("first_index").collect()
    assert [(r["first_index"], r["last_index"], r["caption"]) for r in got] == [(1, 2, "CAPTION0"), (4, 4, "CAPTION5")]
