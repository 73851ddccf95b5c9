"""Question routing, task plans, profiles and revision chains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions.text import contains_any, sentences
from quire.operators.records import topological

# Marks of questions that need depth, and of their intents.
DEEP = ["复现", "审稿", "是否可靠", "完整分析", "深入", "系统分析", "批判", "reproduce", "review", "reliable", "deep analysis", "failure mode"]
ANALYTIC = ["方法", "实验", "局限", "为什么", "如何", "比较", "公式", "消融", "method", "experiment", "limitation", "compare", "ablation", "equation"]
INTENTS = [
    ("REPRODUCTION", ["复现", "reproduce", "代码", "环境"]),
    ("EXPERIMENT", ["实验", "结果", "消融", "experiment", "ablation"]),
    ("CRITICAL", ["局限", "可靠", "审稿", "limitation", "review"]),
    ("FORMULA", ["公式", "equation", "推导"]),
    ("METHOD", ["方法", "method", "模型", "architecture"]),
]
# Fields of work and the words that show them.
DOMAINS = [
    ("目标检测", r"object\s+detection|目标检测"), ("语义分割", r"semantic\s+segmentation|语义分割"), ("大语言模型", r"large\s+language|大语言模型"),
    ("强化学习", r"reinforcement\s+learning|强化学习"), ("知识图谱", r"knowledge\s+graph|知识图谱"), ("图像生成", r"image\s+generation|图像生成"),
]


def depth(question: Column) -> Column:
    """QUICK, ANALYTIC or DEEP by the marks and the length of a question."""
    q = F.trim(F.regexp_replace(F.lower(question), r"\s+", " "))
    return F.when(contains_any(q, DEEP), "DEEP").when(contains_any(q, ANALYTIC) | (F.length(q) > 80), "ANALYTIC").otherwise("QUICK")


def intent(question: Column) -> Column:
    """The first intent of which a question holds a mark, else GENERAL."""
    q = F.trim(F.regexp_replace(F.lower(question), r"\s+", " "))
    out = F.lit("GENERAL")
    for name, marks in reversed(INTENTS):
        out = F.when(contains_any(q, marks), name).otherwise(out)
    return out


def domains(text: Column) -> Column:
    """Sorted fields of work whose words a text holds."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.lower(text).rlike(p), F.lit(n)) for n, p in DOMAINS])))


def revisions(rows: DataFrame, node: str, content: str, order: str) -> DataFrame:
    """(node, revision, content_hash, supersedes, status): the distinct contents of each node in order of arrival."""
    hashed = rows.select(F.col(node).alias("node_id"), F.left(F.sha2(F.coalesce(content, F.lit("")), 256), F.lit(16)).alias("content_hash"), order)
    first = hashed.groupBy("node_id", "content_hash").agg(F.min(order).alias("since"))
    w = W.partitionBy("node_id").orderBy(F.col("since").asc_nulls_first(), "content_hash")
    out = first.select("node_id", F.row_number().over(w).alias("revision"), "content_hash", F.lag("content_hash").over(w).alias("supersedes"), F.lead("content_hash").over(w).alias("_next"))
    return out.select("node_id", "revision", "content_hash", "supersedes", F.when(F.col("_next").isNull(), "ACTIVE").otherwise("SUPERSEDED").alias("status"))


def profile_sentences(blocks: DataFrame, marks: dict[str, list[str]], most: int = 5) -> DataFrame:
    """(paper_version_id, field, place, sentence): the first sentences of each version that hold a mark of the field."""
    s = blocks.where("block_type = 'TEXT'").select("paper_version_id", "page", "block_index", F.posexplode(sentences(F.col("text"))).alias("k", "sentence"))
    low = F.lower("sentence")
    fields = F.array_compact(F.array(*[F.when(contains_any(low, words), F.lit(name)) for name, words in marks.items()]))
    each = s.withColumn("field", F.explode(fields))
    w = W.partitionBy("paper_version_id", "field").orderBy("page", "block_index", "k")
    return each.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("paper_version_id", "field", "place", "sentence")


def heading_score(body: float = 10.0) -> Column:
    """Score of a block as a heading: .48, more for a number, larger or bold type, known names; at most .99."""
    text = F.trim("text")
    numbered = text.rlike(r"^\s*[0-9]+(?:\.[0-9]+){0,3}[.)]?\s+\S")
    known = F.lower(text).rlike(r"(?:abstract|introduction|references|conclusion|acknowledg|appendix|limitations|discussion)")
    add = 0.18 * numbered.cast("int") + 0.18 * (F.coalesce("font_size", F.lit(0.0)) > body * 1.08).cast("int") + 0.12 * F.coalesce("is_bold", F.lit(False)).cast("int") + 0.08 * known.cast("int")
    fits = (F.size(F.split(text, r"\s+")) <= 12) & ~text.rlike(r"[.;,]$") & (F.length(text) > 1)
    return F.when(fits, F.round(F.least(F.lit(0.99), 0.48 + add), 2)).otherwise(0.0)


def plan(kind: str) -> tuple[list[str], list[tuple[str, str]]]:
    """Tasks and dependencies of a run: read, then method and experiments, then the closing task of the intent."""
    tasks = ["read", "method", "experiments", "limits", "report"]
    needs = [("method", "read"), ("experiments", "read"), ("limits", "method"), ("limits", "experiments"), ("report", "limits")]
    if kind == "REPRODUCTION":
        tasks.append("requirements")
        needs += [("requirements", "experiments"), ("report", "requirements")]
    return tasks, needs


def execute(tasks: list[str], needs: list[tuple[str, str]], tools: dict[str, Callable[[dict], DataFrame]]) -> dict[str, tuple[str, DataFrame | None]]:
    """Run a plan's few tasks in order: a missing tool skips a task and what waits for it, a failure does not."""
    done: dict[str, tuple[str, DataFrame | None]] = {}
    for t in topological(tasks, needs):
        before = [d for x, d in needs if x == t]
        if t not in tools or any(done.get(d, ("SKIPPED",))[0] == "SKIPPED" for d in before):
            done[t] = ("SKIPPED", None)
            continue
        try:
            done[t] = ("DONE", tools[t]({d: done[d][1] for d in before}))
        except Exception:  # noqa: BLE001 - a tool's failure is a result of the run
            done[t] = ("FAILED", None)
    return done


def context_pack(papers: DataFrame, findings: DataFrame) -> DataFrame:
    """(paper_id, pack): one JSON text per paper with its title and sorted findings."""
    by = findings.groupBy("paper_id").agg(F.array_sort(F.collect_set("finding")).alias("findings"))
    return papers.join(by, "paper_id", "left").select("paper_id", F.to_json(F.struct(F.coalesce("findings", F.array().cast("array<string>")).alias("findings"), F.col("canonical_title").alias("title"))).alias("pack"))
