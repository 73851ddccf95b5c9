"""Corpus, ledger, usage and report operators around the documents: selections, set operations, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.sources.tables import latest

# What a reproduction needs, and the words that show it is given.
REQUIREMENTS = {"code": ["code", "github", "repository"], "data": ["dataset", "data set", "corpus"], "hyperparameters": ["learning rate", "batch size", "hyperparameter"], "hardware": ["gpu", "tpu"], "seed": ["seed"]}


def corpus(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """(unit_id, paper_version_id, text, section_path, page): the stored chunks of the wanted versions, malformed ones skipped, each once."""
    apt = chunks.where("chunk_id is not null and text is not null and trim(text) != ''").join(versions.select("paper_version_id").distinct(), "paper_version_id", "left_semi")
    return apt.groupBy(F.col("chunk_id").alias("unit_id")).agg(F.max(F.struct("paper_version_id", "text", "section_path", F.col("page_start").alias("page"))).alias("c")).select("unit_id", "c.*")


def owned(df: DataFrame, owner: Column | str, column: str = "user_id") -> DataFrame:
    """Only the rows of one tenant; rows without an owner belong to nobody."""
    return df.where(F.col(column) == owner)


def scoped(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The chunks that hold a wanted block; the whole corpus where none does."""
    hits = chunks.select("chunk_id", F.explode("block_ids").alias("block_id")).join(wanted.select("block_id"), "block_id", "left_semi").select("chunk_id").distinct()
    any_ = hits.agg((F.count("*") > 0).alias("some"))
    marked = chunks.join(hits.withColumn("hit", F.lit(True)), "chunk_id", "left").crossJoin(F.broadcast(any_))
    return marked.where(F.coalesce("hit", F.lit(False)) | ~F.col("some")).drop("hit", "some")


def containing(results: DataFrame, dataset: str | None = None, metric: str | None = None) -> DataFrame:
    """The results whose dataset and metric hold the given words, whatever the case; no word keeps all."""
    out = results
    for column, word in (("dataset", dataset), ("metric", metric)):
        if word:
            out = out.where(F.lower(column).contains(word.lower()))
    return out


def kept_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(source_id, target_id, edge_type): the edges between known vertices, by two semi joins; loops and repeats are left out."""
    known = vertices.select(F.col("node_id"))
    out = edges.join(known, edges["source_id"] == known["node_id"], "left_semi").join(known, edges["target_id"] == known["node_id"], "left_semi")
    return out.where("source_id != target_id").select("source_id", "target_id", "edge_type").distinct()


def gated_fields(fields: DataFrame, ledger: DataFrame) -> DataFrame:
    """(field, status, evidence_ids): known evidence only; FOUND without any is NOT_FOUND_IN_SEARCHED."""
    each = fields.select("field", "status", F.explode_outer("evidence_ids").alias("evidence_id"))
    known = each.join(ledger.select("evidence_id", F.lit(True).alias("known")).distinct(), "evidence_id", "left")
    by = known.groupBy("field", "status").agg(F.array_sort(F.collect_set(F.when(F.col("known"), F.col("evidence_id")))).alias("evidence_ids"))
    return by.select("field", F.when((F.col("status") == "FOUND") & (F.size("evidence_ids") == 0), "NOT_FOUND_IN_SEARCHED").otherwise(F.col("status")).alias("status"), "evidence_ids")


def missing_fields(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted (keys) that are not stored yet."""
    return wanted.join(stored.select(*keys).distinct(), keys, "left_anti")


def key_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): which distinct keys both sides share and which only one has: both, left, right."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full").select(key, F.when(F.col("l").isNull(), "right").when(F.col("r").isNull(), "left").otherwise("both").alias("side"))


def chosen_version(versions: DataFrame, requested: DataFrame) -> DataFrame:
    """(paper_id, version_id): the requested version where the paper has it, else its first by creation and id."""
    first = versions.groupBy("paper_id").agg(F.min_by("version_id", F.struct("created_at", "version_id")).alias("first"))
    asked = requested.join(versions.select("paper_id", "version_id").distinct(), ["paper_id", "version_id"], "left_semi").groupBy("paper_id").agg(F.min("version_id").alias("asked"))
    return first.join(asked, "paper_id", "left").select("paper_id", F.coalesce("asked", "first").alias("version_id"))


def reading_order(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``order_index`` from 0 by page, upper edge, left edge and id within each key and page, pages one behind the other."""
    place = F.row_number().over(W.partitionBy(*keys, "page").orderBy("bbox.y0", "bbox.x0", "block_id"))
    sizes = nodes.groupBy(*keys, "page").agg(F.count("*").alias("n"))
    start = sizes.withColumn("start", F.sum("n").over(W.partitionBy(*keys).orderBy("page")) - F.col("n")).drop("n")
    return nodes.withColumn("place", place).join(start, [*keys, "page"]).withColumn("order_index", (F.col("start") + F.col("place") - 1).cast("long")).drop("place", "start")


def usage(calls: DataFrame, by: list[str]) -> DataFrame:
    """(keys, calls, value): how often and how much, null amounts as nothing."""
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4).alias("value"))


def verdict_counts(pages: DataFrame) -> DataFrame:
    """(paper_version_id, good, suspect, low): pages by verdict."""
    return pages.groupBy("paper_version_id").agg(*[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("GOOD", "SUSPECT", "LOW")])


def parse_benchmark(reports: DataFrame) -> DataFrame:
    """One row: versions, the share of good verdicts, average coverage and fragment ratio."""
    return reports.agg(
        F.count("*").alias("versions"), F.round(F.avg((F.col("verdict") == "GOOD").cast("double")), 6).alias("good_ratio"),
        F.round(F.avg("coverage"), 4).alias("coverage"), F.round(F.avg("fragment_ratio"), 4).alias("fragment_ratio"),
    )


def parse_snapshot(blocks: DataFrame) -> DataFrame:
    """One row of averages over versions: single- and two-character blocks, table rows, formulas, and versions with page steps back."""
    own = blocks.where("text is not null")
    by = own.groupBy("paper_version_id").agg(
        F.avg((F.length(F.trim("text")) == 1).cast("double")).alias("single"), F.avg((F.length(F.trim("text")) <= 2).cast("double")).alias("short"),
        F.count_if(F.col("block_type") == "TABLE_ROW").alias("rows"), F.count_if(F.col("block_type") == "FORMULA").alias("formulas"),
    )
    return by.agg(F.count("*").alias("versions"), *[F.round(F.avg(c), 4).alias(c) for c in ("single", "short", "rows", "formulas")])


def accuracy(rows: DataFrame, expected: str, got: str) -> DataFrame:
    """One row: cases and the share of those in which both agree; nulls disagree."""
    return rows.agg(F.count("*").alias("cases"), F.round(F.avg(F.coalesce((F.col(expected) == F.col(got)).cast("double"), F.lit(0.0))), 6).alias("accuracy"))


def requirements(texts: DataFrame, key: str) -> DataFrame:
    """(key, requirement, given): whether any text of the key holds a mark of each requirement."""
    low = F.lower("text")
    marks = [F.max(F.coalesce(sum((low.contains(m).cast("int") for m in ms), F.lit(0)) > 0, F.lit(False))).alias(r) for r, ms in REQUIREMENTS.items()]
    by = texts.groupBy(key).agg(*marks)
    return by.select(key, F.explode(F.array(*[F.struct(F.lit(r).alias("requirement"), F.col(r).alias("given")) for r in REQUIREMENTS])).alias("x")).select(key, "x.*")


def evidence_package(items: DataFrame, key: str, most: int = 6000) -> DataFrame:
    """(key, package): the evidence of a key between fences, in order of id, texts cut at ``most`` characters with a mark."""
    text = F.coalesce("text", F.lit(""))
    cut = F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("\n…"))).otherwise(text)
    part = F.concat(F.lit("EVIDENCE_ID: "), "evidence_id", F.lit("\nTEXT_START\n"), cut, F.lit("\nTEXT_END"))
    by = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("evidence_id", part.alias("part")))).alias("p"))
    return by.select(key, F.concat(F.lit("<EVIDENCE>\n\n"), F.array_join(F.transform("p", lambda x: x["part"]), "\n\n"), F.lit("\n\n</EVIDENCE>")).alias("package"))


def run_report(findings: DataFrame, key: str, most: int = 12) -> DataFrame:
    """(key, report): Markdown with the first ``most`` findings of a run in order; the cut is the report's form."""
    by = findings.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(F.struct("place", "text"))), 1, most).alias("f"))
    return by.select(key, F.concat(F.lit("# "), F.col(key), F.lit("\n\n"), F.array_join(F.transform("f", lambda x: F.concat(F.lit("- "), x["text"])), "\n")).alias("report"))


def stable_json(df: DataFrame, key: str) -> DataFrame:
    """(key, json): each row's other columns as compact JSON in alphabetical order, nulls kept."""
    rest = sorted(c for c in df.columns if c != key)
    return df.select(key, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("json"))


def safe_json(text: Column, path: str, fallback: str = "") -> Column:
    """A field of a JSON text, fences stripped; the fallback where the text is no JSON or lacks the field."""
    bare = F.regexp_replace(F.trim(text), r"^```[a-z]*\s*|\s*```$", "")
    return F.coalesce(F.get_json_object(bare, path), F.lit(fallback))


def rewritten(df: DataFrame, key: str, ids: list, change: dict[str, Column]) -> DataFrame:
    """UPDATE ... WHERE key IN (ids): the table with the columns changed on those rows."""
    hit = F.col(key).isin(ids)
    return df.select(*[F.when(hit, change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in df.columns])


def migrated(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The table with every listed column: missing ones are added as nulls of their type, others kept."""
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in columns.items() if c not in df.columns])


def documents_of_kind(df: DataFrame, kind_column: str, kind: str, key: str, order: str) -> DataFrame:
    """The last stored row per key of one kind; the kind is a filter that reaches the scan."""
    return latest(df.where(F.col(kind_column) == kind), key, order)
