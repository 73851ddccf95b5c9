"""Problem 6: pieces of oversized chunks, cut where the topic turns.

Sentences are compared in sliding blocks: the cohesion at a gap is the cosine of
the word counts of the sentences before and after it, and its depth is how far
the cohesion rises on both sides. Within each size window the cut goes to the
deepest valley, paragraph ends first, then sentence ends; only a sentence that
alone is too long is cut at a clause, and failing that between words. Each piece
then starts with the last 40 to 60 tokens of the piece before.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quire.session import spread

LIMIT, OVERLAP_LEAST, OVERLAP_MOST = 650, 40, 60
#: Sentences on each side of a gap that are compared.
BLOCK = 3
#: Part of the window, from its end, in which the deepest valley is looked for.
WINDOW = 0.45

_UNIT = re.compile(r"[A-Za-z0-9_]+|[㐀-鿿]|[^\w\s]|\w|\s+")
_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+|(?<=[。！？])\s*|\n\s*\n\s*")
_CLAUSE = re.compile(r"[,;:，；：]\s*|\n\s*")
_WORD = re.compile(r"[^\W\d_]{3,}|[㐀-鿿]")


def token_count(text: Column) -> Column:
    """Runs of ASCII letters, digits and ``_``, CJK characters, and a third of the marks."""
    runs = F.regexp_count(text, F.lit("[A-Za-z0-9_]+"))
    cjk = F.regexp_count(text, F.lit("[㐀-鿿]"))
    marks = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}_\p{IsWhite_Space}]"))
    return runs + cjk + F.floor(marks / 3).cast("int")


class Scale:
    """Token counts of any stretch of one text, by prefix sums at unit borders."""

    def __init__(self, text: str):
        self.at, self.whole, self.marks = [0], [0], [0]
        whole = marks = 0
        for m in _UNIT.finditer(text):
            unit = m.group()
            first = unit[0]
            if first.isascii() and (first.isalnum() or first == "_") or "㐀" <= first <= "鿿":
                whole += 1
            elif not (first.isalnum() or first == "_" or first.isspace()):
                marks += 1
            self.at.append(m.end())
            self.whole.append(whole)
            self.marks.append(marks)

    def index(self, pos: int) -> int:
        return bisect_right(self.at, pos) - 1

    def count(self, a: int, b: int) -> int:
        i, j = self.index(a), self.index(b)
        return self.whole[j] - self.whole[i] + (self.marks[j] - self.marks[i]) // 3

    def reach(self, a: int, limit: int) -> int:
        """The last unit border up to which the text from ``a`` stays within the limit."""
        i = self.index(a)
        lo, hi = i, len(self.at) - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.whole[mid] - self.whole[i] + (self.marks[mid] - self.marks[i]) // 3 <= limit:
                lo = mid
            else:
                hi = mid - 1
        return self.at[lo]

    def back(self, b: int, tokens: int) -> int:
        """The latest unit border from which the text up to ``b`` has that many tokens."""
        j = self.index(b)
        lo, hi = 0, j
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.whole[j] - self.whole[mid] + (self.marks[j] - self.marks[mid]) // 3 >= tokens:
                lo = mid
            else:
                hi = mid - 1
        return self.at[lo]


def valleys(text: str, borders: list[int]) -> dict[int, float]:
    """Depth of the cohesion valley at each border between sentences."""
    spans = list(zip([0, *borders], [*borders, len(text)]))
    bags = [Counter(w.lower() for w in _WORD.findall(text[a:b])) for a, b in spans]
    scores = []
    for g in range(1, len(bags)):
        left, right = Counter(), Counter()
        for bag in bags[max(0, g - BLOCK) : g]:
            left.update(bag)
        for bag in bags[g : g + BLOCK]:
            right.update(bag)
        dot = sum(n * right[w] for w, n in left.items())
        norm = math.sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values()))
        scores.append(dot / norm if norm else 0.0)
    depth = {}
    for g, s in enumerate(scores):
        peak_left = peak_right = s
        for k in range(g - 1, -1, -1):
            if scores[k] < peak_left:
                break
            peak_left = scores[k]
        for k in range(g + 1, len(scores)):
            if scores[k] < peak_right:
                break
            peak_right = scores[k]
        depth[borders[g]] = peak_left + peak_right - 2 * s
    return depth


def split(text: str, limit: int = LIMIT, least: int = OVERLAP_LEAST, most: int = OVERLAP_MOST) -> list[tuple[int, int]]:
    """(start, end) of each piece; a text within the limit is one piece."""
    scale = Scale(text)
    if scale.count(0, len(text)) <= limit:
        return [(0, len(text))]
    borders = sorted({m.end() for m in _END.finditer(text) if 0 < m.end() < len(text)})
    depth = valleys(text, borders)
    paragraph = {b for b in borders if "\n\n" in text[max(0, b - 4) : b] or re.search(r"\n\s*\n\s*$", text[max(0, b - 8) : b])}
    pieces, start = [], 0
    while True:
        stop = scale.reach(start, limit)
        if stop >= len(text):
            pieces.append((start, len(text)))
            return pieces
        floor = scale.reach(start, max(most + 1, int(limit * (1 - WINDOW))))
        inside = borders[bisect_right(borders, floor) : bisect_right(borders, stop)]
        if not inside:  # nothing in the window: any sentence end after the overlap
            inside = borders[bisect_right(borders, scale.reach(start, most + 1)) : bisect_right(borders, stop)][-1:]
        whole = [b for b in inside if b in paragraph]
        if whole or inside:
            end = max(whole or inside, key=lambda b: (depth.get(b, 0.0), b))
        else:
            clauses = [m.end() for m in _CLAUSE.finditer(text, floor, stop) if m.end() < stop]
            blanks = [m.end() for m in re.finditer(r"\s+", text[floor:stop])]
            end = clauses[-1] if clauses else floor + blanks[-1] if blanks else stop
        pieces.append((start, end))
        # The overlap starts at a sentence where one lies within its bounds, else at a word.
        far, near = scale.back(end, most), scale.back(end, least)
        inner = borders[bisect_right(borders, far - 1) : bisect_right(borders, near)]
        word = next((m.end() for m in re.finditer(r"\s+", text[far:near]) if scale.count(far + m.end(), end) <= most), None)
        nxt = inner[0] if inner else far + word if word is not None and scale.count(far + word, end) >= least else far
        if nxt <= start:
            nxt = near if near > start else end
        start = nxt


SCHEMA = "chunk_id string, piece int, char_start int, char_end int, tokens int, overlap int, page_start int, text string"


def _cut(limit: int, least: int, most: int):
    def run(frames):
        for pdf in frames:
            rows = []
            for chunk, text, page, segments in zip(pdf["chunk_id"], pdf["text"], pdf["page_start"], pdf["segments"]):
                scale = Scale(text)
                before = 0
                marks = sorted((s["chunk_char_start"], s["page"]) for s in segments if s is not None and s["chunk_char_start"] is not None) if segments is not None else []
                for k, (a, b) in enumerate(split(text, limit, least, most)):
                    i = bisect_right(marks, (a, math.inf)) - 1
                    on = marks[i][1] if i >= 0 and marks[i][1] is not None else page
                    on = None if on is None or on != on else int(on)
                    rows.append((chunk, k, a, b, scale.count(a, b), scale.count(a, before) if k else 0, on, text[a:b]))
                    before = b
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            yield out.astype({"page_start": "Int32"})

    return run


def pieces(chunks: DataFrame, limit: int = LIMIT, least: int = OVERLAP_LEAST, most: int = OVERLAP_MOST) -> DataFrame:
    """Pieces of at most ``limit`` tokens of the chunks whose text is over it.

    Sizes are measured on the text; ``token_estimate`` is never read. A piece's
    page is that of the segment it starts in, else the chunk's own. Null and empty
    texts give no piece; repeated rows give the same pieces again.
    """
    need = ["chunk_id", "text", "page_start", "segments"]
    over = chunks.where(F.col("text").isNotNull()).select(*need).where(token_count(F.col("text")) > limit)
    return spread(over).mapInPandas(_cut(limit, least, most), SCHEMA)


def within(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """All chunks as pieces: those within the limit whole, the others cut."""
    whole = chunks.where(F.col("text").isNotNull() & (F.col("text") != "")).withColumn("tokens", token_count(F.col("text"))).where(F.col("tokens") <= limit)
    page = F.coalesce(F.get("segments.page", F.lit(0)), F.col("page_start"))
    kept = whole.select(
        "chunk_id", F.lit(0).alias("piece"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"), "tokens",
        F.lit(0).alias("overlap"), page.alias("page_start"), "text",
    )
    return kept.unionByName(pieces(chunks, limit))


def found(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(chunk_id): chunks the splitter cuts, that is, those over the limit."""
    return pieces(chunks, limit).where("piece >= 1 and chunk_id is not null").select("chunk_id").distinct()
