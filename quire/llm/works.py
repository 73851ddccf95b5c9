"""Problem 7: records of one work in the catalogues of different providers.

A cascade of deterministic rules, each an equi-join on a weaker combination of
attributes: all title words with an author, all title words alone, the same on
words whose slips are folded, then titles that differ by one word and by two. Two
titles that lose at most ``k`` words each share ``j`` of the ``k + j`` rarest words
of either, so the joins are on two rare words with an author, or on three rare
words, and the titles of what meets are compared. A record that a pass has
linked to a provider is left out of later passes towards that provider. The last
rule joins records that matched a common third one. A rule's confidence is its
smoothed precision on its links whose venues, which no rule reads, are known on
both sides: links whose venues agree count as right.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.names import _omissions, clean, components, fold, one_slip
from quire.session import durable, pairs_within, sized_broadcast
from quire.sources.tables import latest

# Short forms in titles, words that carry nothing, notes about the copy.
SHORT = {
    "4": "for", "w/": "with", "w": "with", "&": "and", "est": "estimation", "seg": "segmentation", "trans": "transcription",
    "transcr": "transcription", "idx": "indexing", "rec": "recovery", "recog": "recognition", "vs": "versus", "intro": "introduction",
}
EMPTY = {"for", "of", "the", "and", "in", "with", "on", "under", "a", "an", "to", "via", "from", "by", "at"}
NOTES = r"\b(extended abstract|extended version|preprint|supplementary version|supplementary material|technical report|full version|short paper|poster|draft|author version|accepted version|camera ready|arxiv version|v[0-9])\b"
GENERIC = {"survey", "overview", "introduction", "review", "tutorial", "editorial", "preface", "notes", "lecture", "guide", "primer", "perspective"}
_KINDS = [
    ("reply", r"^(?:a |an )?(?:reply|response|comment|comments|rejoinder|note)s? (?:to|on) "),
    ("beyond", r"^beyond "),
    ("revisited", r" (?:revisited|reconsidered|reloaded)$"),
    ("part", r",? (?:part|volume|vol|no|chapter) (?:[ivx]+|[0-9]+|one|two|three)$| (?:ii|iii|iv|2|3)$"),
    ("sequel", r"^(?:more on|further|towards|toward|rethinking again) | (?:continued|again|strikes back)$"),
]
#: Pairs that every rule is taken to have proposed beforehand: right ones and all.
PRIOR_RIGHT, PRIOR_ALL = 1.0, 2.0


def title_words(title: str | None) -> tuple[str, list[str]]:
    """(kind, words): whether the title is a reply, part or revisit, and its content words in order."""
    if not title:
        return "", []
    t = re.sub(r"<[^>]+>", " ", title)
    t = re.sub(r"\s+w/\s*", " with ", t).replace("&", " and ")
    t = re.sub(r"[(\[][^)\]]*[)\]]", " ", t)
    t = " ".join(fold(w) for w in re.split(r"[^\w]+", t) if fold(w))
    t = re.sub(r"\s+", " ", re.sub(NOTES, " ", t)).strip()
    kind = []
    while True:  # a reply may itself be revisited
        for name, pattern in _KINDS:
            m = re.search(pattern, t)
            if m and m.group().strip(" ,") != t:
                kind.append(name + (":" + m.group().split()[-1] if name == "part" else ""))
                t = (t[: m.start()] + " " + t[m.end() :]).strip()
                break
        else:
            break
    words = [SHORT.get(w, w) for w in t.split()]
    return "+".join(sorted(kind)), [w for w in words if w not in EMPTY and len(w) > 1]


def author_words(authors) -> list[str]:
    out = set()
    for a in authors if authors is not None else []:
        if a and a.strip().lower().rstrip(".") not in ("et al", "others"):
            out |= {w for w in (fold(x) for x in re.split(r"[\s,.\-]+", clean(a))) if len(w) >= 3}
    return sorted(out)


def venue_sign(venue: str | None) -> str | None:
    """Initials of a venue's words, equal for its full and its abbreviated name."""
    words = [fold(w) for w in re.split(r"[^\w]+", venue or "")]
    return "".join(w[0] for w in words if w and w not in EMPTY) or None


CLEAN = "record_id bigint, provider string, kind string, words array<string>, authors array<string>, year int, generic boolean, venue string, tail string"


def _clean(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for rid, provider, title, authors, year, venue in zip(pdf["record_id"], pdf["provider"], pdf["title"], pdf["authors"], pdf["year"], pdf["venue"]):
            kind, words = title_words(title)
            tail = " ".join(words[-TAIL:]) if len(words) >= TAIL else None
            words = sorted(set(words))
            rows.append((rid, provider, kind, words, author_words(authors), None if year != year or year is None else int(year), bool(set(words) & GENERIC) or len(words) < 3, venue_sign(venue), tail))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in CLEAN.split(", ")])
        yield out.astype({"year": "Int32"})


#: Words at the end of a title that make its tail.
TAIL = 3
#: (rule, slips folded, words lost on either side (None: one title ends in the other), author in the key, least common words, equal years)
RULES = [
    ("title+author", False, 0, True, 1, False), ("title", False, 0, False, 3, False),
    ("slips+author", True, 0, True, 1, False), ("slips", True, 0, False, 3, False),
    ("title-1+author", True, 1, True, 3, False), ("title-1", True, 1, False, 4, False),
    ("title-2+author", True, 2, True, 3, False), ("title-2", True, 2, False, 4, True),
    ("tail+author", False, None, True, TAIL, False),
]


def _near(a: Column, b: Column) -> Column:
    """Whether the author words share one, or two long ones are a slip apart."""
    slip = F.exists(a, lambda x: F.exists(b, lambda y: (F.least(F.length(x), F.length(y)) >= 6) & (F.levenshtein(x, y, 2) >= 0)))
    return F.arrays_overlap(a, b) | slip


def _are_slips(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        yield pdf[[one_slip(a, b) for a, b in zip(pdf["word"], pdf["other"])]]


def slips_folded(records: DataFrame) -> DataFrame:
    """The records with each title word of five letters on replaced by its commonest spelling one slip away, if commoner."""
    said = records.select("record_id", F.explode("words").alias("word"))
    count = durable(said.groupBy("word").agg(F.count("*").alias("n")).where(F.length("word") >= 5))
    forms = durable(count.withColumn("form", F.explode(_omissions(F.col("word")))))
    near = forms.join(forms.select("form", F.col("word").alias("other"), F.col("n").alias("others")), "form").where("others > n or (others = n and other < word)")
    near = durable(near.select("word", "other", "others").distinct())
    # Two spellings that stand in one title are two words (a singular and its plural), not a slip.
    together = near.join(said, "word").join(said.withColumnRenamed("word", "other"), ["record_id", "other"]).select("word", "other").distinct()
    near = near.join(together, ["word", "other"], "left_anti").mapInPandas(_are_slips, "word string, other string, others long")
    fixed = durable(near.groupBy("word").agg(F.max_by("other", F.struct("others", "other")).alias("good")))
    fixed = sized_broadcast(fixed)
    whole = said.join(fixed, "word", "left").groupBy("record_id").agg(F.array_sort(F.collect_set(F.coalesce("good", "word"))).alias("words"))
    return durable(records.drop("words").join(whole, "record_id").select(*records.columns))


def rarest_first(records: DataFrame) -> DataFrame:
    """The records with ``rare``: their title words, the word of fewest records first."""
    said = records.select("record_id", F.explode("words").alias("word"))
    counts = durable(said.groupBy("word").agg(F.count("*").alias("n")))
    order = said.join(sized_broadcast(counts), "word").groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("o"))
    return durable(records.join(order.select("record_id", F.col("o.word").alias("rare")), "record_id"))


def _choices(words: Column, n: int) -> Column:
    """Every choice of ``n`` of the words, joined in alphabetical order."""
    if n == 1:
        return words
    head = F.array_sort(words)
    return F.flatten(F.transform(head, lambda x, i: F.transform(_choices(F.slice(head, i + 2, F.size(head)), n - 1), lambda y: F.concat_ws(" ", x, y))))


def _keys(records: DataFrame, lost: int | None, author: bool, least: int) -> DataFrame:
    """(key, v): the join keys of one rule as hashes, with the provider and id of the record."""
    apt = records.where(F.size("words") >= least)
    if not author:
        apt = apt.where("not generic")
    if lost is None:
        apt, forms = apt.where("tail is not null"), F.array("tail")
    elif lost == 0:
        forms = F.array(F.array_join("words", " "))
    else:  # two (without an author three) of the rarest words are common
        forms = _choices(F.slice("rare", 1, lost + (2 if author else 3)), 2 if author else 3)
    out = apt.withColumn("form", F.explode(forms))
    parts = ["kind", "form"]
    if author:
        out, parts = out.withColumn("who", F.explode("authors")), [*parts, "who"]
    return out.select(F.xxhash64(*parts).alias("key"), F.struct(F.xxhash64("provider").alias("p"), F.col("record_id").alias("r")).alias("v")).distinct()


def matched(provider_records: DataFrame) -> DataFrame:
    """(record_id_a, record_id_b, rule, confidence): links between records of different providers.

    Years of a link differ by at most one where both are known; replies, parts and
    revisits only match their like; a generic title needs a common author; where
    both records name authors they must share a name. Of repeated rows the last
    ingested counts; records without a title, or with a null id or provider, match
    nothing.
    """
    base = provider_records.where("record_id is not null and provider is not null and title is not null")
    need = ["record_id", "provider", "title", "authors", "year"]
    has = set(base.columns)
    base = base.select(*need, *[(F.col(c) if c in has else F.lit(None).cast(t)).alias(c) for c, t in (("venue", "string"), ("ingested_at", "timestamp"))])
    rows = latest(base, "record_id").mapInPandas(_clean, CLEAN)
    records = rarest_first(durable(rows.where(F.size("words") > 0)))
    folded = rarest_first(slips_folded(records.drop("rare")))
    linked: list[DataFrame] = []
    slots = None

    def sides(pairs: DataFrame, source: DataFrame) -> DataFrame:
        for x in "ab":
            of = [F.col(c).alias(f"{c}_{x}") for c in ("provider", "kind", "words", "authors", "year", "venue")]
            pairs = pairs.join(source.select(F.col("record_id").alias(x), *of), x)
        return pairs

    def judged(pairs: DataFrame, rule: str) -> DataFrame:
        """The links with their rule's precision by the venues."""
        links = durable(pairs.select("a", "b", "provider_a", "provider_b", (F.col("venue_a") == F.col("venue_b")).alias("agree")))
        told = links.agg(F.count_if("agree").alias("right"), F.count("agree").alias("all")).first()
        return links.select("a", "b", "provider_a", "provider_b", F.lit(rule).alias("rule"), F.lit((told["right"] + PRIOR_RIGHT) / (told["all"] + PRIOR_ALL)).alias("confidence"))

    for rule, fold_, lost, author, least, equal in RULES:
        source = folded if fold_ else records
        # Keys and what meets are cut off, so no pass computes them twice and every plan stays small.
        keys = durable(_keys(source, lost, author, least))
        met = durable(pairs_within(keys, "key", "v").where("x.p != y.p").select("x", "y").distinct())
        if slots is not None:  # before anything else is looked up
            for one, other in (("x", "y"), ("y", "x")):
                met = met.join(slots, (F.col(f"{one}.r") == slots["r"]) & (F.col(f"{other}.p") == slots["p"]), "left_anti")
        pairs = sides(met.select(F.least("x.r", "y.r").alias("a"), F.greatest("x.r", "y.r").alias("b")), source).where("provider_a != provider_b and kind_a = kind_b")
        gap = F.abs(F.col("year_a") - F.col("year_b"))
        pairs = pairs.where(F.coalesce(gap == 0, F.lit(False)) if equal else F.coalesce(gap <= 1, F.lit(True)))
        only_a, only_b = F.size(F.array_except("words_a", "words_b")), F.size(F.array_except("words_b", "words_a"))
        pairs = pairs.where(F.least(only_a, only_b) == 0 if lost is None else (only_a <= lost) & (only_b <= lost))
        pairs = pairs.where(F.size("words_a") - only_a >= least)
        both = (F.size("authors_a") > 0) & (F.size("authors_b") > 0)
        common = _near(F.col("authors_a"), F.col("authors_b"))
        pairs = pairs.where(common if author else ~both | common)
        linked.append(judged(pairs, rule))
        done = reduce(DataFrame.unionByName, linked)
        slots = durable(done.select(F.col("a").alias("r"), F.xxhash64("provider_b").alias("p")).union(done.select("b", F.xxhash64("provider_a"))).distinct())
    direct = durable(reduce(DataFrame.unionByName, linked))
    # Records that matched a common third, however many steps away.
    edges = direct.select(F.explode(F.array("a", "b")).alias("name"), F.concat_ws("|", "a", "b").alias("form"))
    groups = components(durable(edges)).join(records.select(F.col("record_id").alias("name"), F.struct(F.xxhash64("provider").alias("p"), F.col("record_id").alias("r")).alias("v")), "name")
    met = pairs_within(groups.select("entity", "v"), "entity", "v").where("x.p != y.p").select(F.least("x.r", "y.r").alias("a"), F.greatest("x.r", "y.r").alias("b"))
    pairs = sides(met.join(direct.select("a", "b"), ["a", "b"], "left_anti"), records)
    last = judged(pairs.where(F.coalesce(F.abs(F.col("year_a") - F.col("year_b")) <= 1, F.lit(True))), "common match")
    return direct.unionByName(last).groupBy(F.col("a").alias("record_id_a"), F.col("b").alias("record_id_b")).agg(
        F.max_by("rule", "confidence").alias("rule"), F.round(F.max("confidence"), 4).alias("confidence")
    )


def found(provider_records: DataFrame) -> DataFrame:
    """(record_id_a, record_id_b): the linked pairs, the smaller id first."""
    return matched(provider_records).select("record_id_a", "record_id_b")
