"""Problem 8: evaluation passages inside the training corpus.

Wu-Manber multi-pattern search with words as symbols. The patterns are all
windows of ``run`` words of the test passages. A shift table over blocks of two
words skips the positions where no window can end; where the shift is zero, the
bucket of that last block, keyed by the window's first block, holds the windows
that may end here, and a word-by-word comparison confirms them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.session import spread

#: Words in a row that make a leak.
RUN = 10
#: Test text held by one search table; more test text makes more tables and passes.
TABLE_CHARS = 8_000_000


def plain_words(text: Column) -> Column:
    """Lower-case words joined by single blanks: no case, punctuation, spacing or line breaks."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


class Patterns:
    """Shift table and suffix buckets of the windows of all passages."""

    def __init__(self, passages: list[tuple[int, str]], run: int = RUN):
        self.run = run
        self.ids: dict[str, int] = {}
        self.shift: dict[tuple[int, int], int] = {}
        self.buckets: dict[tuple[int, int], dict[tuple[int, int], list[tuple[int, int]]]] = {}
        self.texts: list[tuple[int, list[int]]] = []
        for item, text in passages:
            words = [self.ids.setdefault(w, len(self.ids)) for w in text.split()]
            at = len(self.texts)
            self.texts.append((item, words))
            for s in range(len(words) - run + 1):
                window = words[s : s + run]
                for q in range(1, run):
                    block = (window[q - 1], window[q])
                    self.shift[block] = min(self.shift.get(block, run - 1), run - 1 - q)
                last, first = (window[-2], window[-1]), (window[0], window[1])
                self.buckets.setdefault(last, {}).setdefault(first, []).append((at, s))

    def search(self, text: str) -> set[int]:
        """Items of which the text holds a window."""
        run, get = self.run, self.ids.get
        words = [get(w, -1) for w in text.split()]
        found: set[int] = set()
        i, n, most = run - 1, len(words), run - 1
        shift, buckets, texts = self.shift, self.buckets, self.texts
        while i < n:
            block = (words[i - 1], words[i])
            step = shift.get(block, most)
            if step:
                i += step
                continue
            s = i - run + 1
            for at, start in buckets[block].get((words[s], words[s + 1]), ()):
                item, pattern = texts[at]
                if item not in found and pattern[start : start + run] == words[s : i + 1]:
                    found.add(item)
            i += 1
        return found


def _scan(patterns):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = patterns.value
        for batch in batches:
            docs, items = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hits = table.search(text)
                docs += [doc] * len(hits)
                items += sorted(hits)
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field(0).type), pa.array(items, pa.int64())], names=["doc_id", "item_id"])

    return run


def found(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, item_id): every document with at least ``run`` words in a row of the item's text.

    Null, empty and shorter texts on either side match nothing; repeated rows
    give one row; whole texts are searched, however long. The test set is cut
    into tables of bounded size, each of which scans the corpus once.
    """
    spark = documents.sparkSession
    sized = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), plain_words(F.col("text")).alias("text"))
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = -(-total // TABLE_CHARS) or 1
    docs = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text")).select("doc_id", plain_words(F.col("text")).alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    out = None
    for k in range(slices):
        part = sized if slices == 1 else sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        table = Patterns([(r["item_id"], r["text"]) for r in part.distinct().collect()], run)
        hits = docs.mapInArrow(_scan(spark.sparkContext.broadcast(table)), f"doc_id {kind}, item_id long")
        out = hits if out is None else out.unionByName(hits)
    return out.distinct()


def report(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """(item_id, documents): every test item with the number of documents it leaked into."""
    hits = found(documents, items, run).groupBy("item_id").agg(F.count("*").alias("documents"))
    ids = items.where("item_id is not null").select(F.col("item_id").cast("long")).distinct()
    return ids.join(hits, "item_id", "left").fillna(0, ["documents"])
