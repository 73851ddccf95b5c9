"""Problem 10: the language of documents and of their segments.

Error-correcting output codes: each language has a codeword, one binary n-gram
classifier predicts each bit, and a text gets the language whose codeword loses
least against the predicted margins. Close losses are flagged as ambiguous.

The classifiers are trained here on a bounded sample of labelled documents
(``SAMPLE_DOCS`` per language, picked by a hash of the id, ``SAMPLE_SENTENCES``
sentences of each with ``SAMPLE_WORDS`` words at most); labels are partly
wrong, so a second round drops the sentences that disagree with their label.
Every document and every sentence is then labelled, whatever the size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quire.session import hash_sample, spread

LANGUAGES = ["de", "en", "es", "fr", "pt", "ru", "zh"]
# Other spellings of the codes above.
SPELLINGS = {
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "en": ["en", "eng", "english"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "ru": ["ru", "rus", "russian", "русский"],
    "zh": ["zh", "zho", "chi", "cmn", "chinese", "中文", "汉语"],
}
SAMPLE_DOCS = 300
SAMPLE_SENTENCES = 12
SAMPLE_WORDS, SAMPLE_LETTERS = 200, 40
BITS = 15
DIM = 1 << 15
EPOCHS = 4
SEED = 17
#: A sentence has at least this many words (CJK: characters).
LEAST_WORDS, LEAST_CJK = 4, 6
#: Confidence under which a decision is ambiguous as well.
UNSURE = 0.8
#: Loss gap, relative to the least loss, under which a decision is ambiguous.
CLOSE = 0.12

_WORDS = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+")
_SENTENCE = re.compile(r"[^.!?。！？\n]+(?:[.!?](?!\s|$)[^.!?。！？\n]*)*[.!?。！？]*")
_ENDED = re.compile(r"[.!?。！？][\"')\]»”]*\s*$")


def normal_label(label: Column) -> Column:
    """The language code a label stands for; null where it stands for none of them."""
    base = F.regexp_replace(F.lower(F.trim(label)), r"[-_ (].*$", "")
    out = F.lit(None).cast("string")
    for code, names in SPELLINGS.items():
        out = F.when(base.isin(names), F.lit(code)).otherwise(out)
    return out


def codewords(seed: int = SEED) -> np.ndarray:
    """Codewords of +1/-1 with the largest least distance found among seeded draws."""
    rng = np.random.default_rng(seed)
    best, least = None, -1
    for _ in range(3000):
        code = rng.choice([-1, 1], size=(len(LANGUAGES), BITS))
        apart = min((code[i] != code[j]).sum() for i in range(len(code)) for j in range(i))
        if apart > least and (np.abs(code.sum(0)) < len(code)).all():
            best, least = code, apart
    return best.astype(np.float32)


def features(word: str) -> list[int]:
    """Hashed n-grams of one word: the word itself and its pieces of one to four letters."""
    w = f"^{word.lower()}$"
    out = [zlib.crc32(w.encode()) % DIM]
    for n in (1, 2, 3, 4):
        out += [zlib.crc32(f"{n}{w[i : i + n]}".encode()) % DIM for i in range(len(w) - n + 1)]
    return out


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each sentence; stretches too short to tell join none."""
    out = []
    for m in _SENTENCE.finditer(text):
        words = _WORDS.findall(m.group())
        if words:
            out.append((m.start(), m.end(), words))
    return out


def is_whole(words: list[str]) -> bool:
    cjk = sum("㐀" <= w[0] <= "鿿" for w in words)
    return cjk >= LEAST_CJK or len(words) - cjk >= LEAST_WORDS


class Model:
    """Bit classifiers over hashed n-grams, with a bounded cache of word scores."""

    def __init__(self, weights: np.ndarray, code: np.ndarray):
        self.weights, self.code = weights, code
        self.cache: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, BITS), np.float32)
        self.sizes = np.zeros(1 << 12, np.float32)

    def __getstate__(self):
        return self.weights, self.code

    def __setstate__(self, state):
        self.__init__(*state)

    def word(self, w: str) -> int:
        at = len(self.cache)
        if at == len(self.sizes):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        f = features(w)
        self.scores[at] = self.weights[f].sum(0)
        self.sizes[at] = len(f)
        self.cache[w] = at
        return at

    def losses(self, spans: list[list[str]]) -> np.ndarray:
        """Loss of every language for every list of words."""
        if len(self.cache) > 400_000:
            self.cache.clear()
        flat, lengths, cache = [], [], self.cache
        for words in spans:
            lengths.append(len(words))
            for w in words:
                i = cache.get(w)
                flat.append(self.word(w) if i is None else i)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        total = np.add.reduceat(self.scores[flat], starts, axis=0)
        size = np.add.reduceat(self.sizes[flat], starts)
        margin = np.clip(total / np.sqrt(size)[:, None], -8, 8)
        return np.exp(-margin[:, None, :] * self.code[None]).sum(2)


def decode(losses: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, confidence, ambiguous) by the least loss-weighted distance."""
    order = np.sort(losses, axis=1)
    best = losses.argmin(1)
    share = 1 / losses
    confidence = share[np.arange(len(best)), best] / share.sum(1)
    return best, confidence, ((order[:, 1] - order[:, 0]) < CLOSE * (order[:, 0] + 1)) | (confidence < UNSURE)


def train(data: list[tuple[int, list[str]]], seed: int = SEED) -> Model:
    """Fit the bit classifiers on (language, words) of sentences, twice, dropping disagreeing sentences between."""
    code = codewords(seed)
    rng = np.random.default_rng(seed)
    memo: dict[str, list[int]] = {}
    rows = []
    for y, words in data:
        f = []
        for w in words:
            if w not in memo:
                memo[w] = features(w)
            f += memo[w]
        rows.append((y, np.array(f)))
    weights = np.zeros((DIM, BITS), np.float32)
    for again in range(2):
        weights = np.zeros((DIM, BITS), np.float32)
        for epoch in range(EPOCHS):
            step = 0.5 / (1 + epoch)
            for k in rng.permutation(len(rows)):
                y, f = rows[k]
                scale = 1 / np.sqrt(len(f))
                margin = np.clip(weights[f].sum(0) * scale, -30, 30) * code[y]
                np.add.at(weights, f, (step * scale * code[y] / (1 + np.exp(margin))).astype(np.float32))
        if again or not data:
            break
        best, _, _ = decode(Model(weights, code).losses([w for _, w in data]))
        kept = [k for k in range(len(data)) if best[k] == data[k][0]]
        data, rows = [data[k] for k in kept], [rows[k] for k in kept]
    return Model(weights, code)


def _sentences(frames):
    for pdf in frames:
        rows = []
        for doc, lang, text in zip(pdf["doc_id"], pdf["is_lang"], pdf["text"]):
            whole = [w for _, _, w in sentences(text) if is_whole(w)][:SAMPLE_SENTENCES]
            rows += [(doc, lang, k, [w[:SAMPLE_LETTERS] for w in words[:SAMPLE_WORDS]]) for k, words in enumerate(whole)]
        yield pd.DataFrame(rows, columns=["doc_id", "is_lang", "place", "words"])


def fit(documents: DataFrame, sample: int = SAMPLE_DOCS) -> Model:
    """Train on at most ``sample`` labelled documents per language, the first by a hash of the id.

    Of each, ``SAMPLE_SENTENCES`` whole sentences, of these ``SAMPLE_WORDS`` words,
    cut to ``SAMPLE_LETTERS``, come to the driver, so the training data have a bound.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    labelled = documents.where("text is not null").withColumn("is_lang", normal_label(F.col("lang")))
    ids = hash_sample(labelled, "is_lang", "doc_id", LANGUAGES, sample, SEED)
    picked = labelled.join(F.broadcast(ids.withColumnRenamed("is_lang", "as_lang")), "doc_id").where("is_lang = as_lang").select("doc_id", "is_lang", "text")
    rows = picked.mapInPandas(_sentences, f"doc_id {kind}, is_lang string, place int, words array<string>").distinct().orderBy("doc_id", "is_lang", "place").collect()
    return train([(LANGUAGES.index(r["is_lang"]), list(r["words"])) for r in rows])


SEGMENTS = "char_start int, char_end int, lang string, confidence double, ambiguous boolean, sentences int"


def _label(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            docs, spans, owners, whole = batch.column(0), [], [], []
            places: list[tuple[int, int]] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for a, b, words in sentences(text):
                    spans.append(words)
                    places.append((a, b))
                    owners.append(i)
                    whole.append(bool(_ENDED.search(text, max(a, b - 4), b)) and is_whole(words))
            if not spans:
                continue
            losses = m.losses(spans)
            best, confidence, close = decode(losses)
            out: dict[str, list] = {k: [] for k in ("row", "char_start", "char_end", "lang", "confidence", "ambiguous", "sentences")}

            def flush(i, run_, lang):
                sure = [k for k in run_ if whole[k]]
                at = sure or run_
                out["row"].append(i)
                out["char_start"].append(places[run_[0]][0])
                out["char_end"].append(places[run_[-1]][1])
                out["lang"].append(LANGUAGES[lang])
                out["confidence"].append(float(confidence[at].mean()))
                out["ambiguous"].append(bool(close[at].all()))
                out["sentences"].append(sum(1 for k in sure if not close[k]))

            k, n = 0, len(spans)
            while k < n:
                i, mine = owners[k], []
                while k < n and owners[k] == i:
                    mine.append(k)
                    k += 1
                firm = [j for j in mine if whole[j] and not close[j]]
                first = best[firm[0]] if firm else LANGUAGES.index(LANGUAGES[int(losses[mine].sum(0).argmin())])
                run_, now = [], first
                for j in mine:  # fragments and close calls stay with the segment they stand in
                    lang = best[j] if whole[j] and not close[j] else now
                    if lang != now and run_:
                        flush(i, run_, now)
                        run_ = []
                    run_.append(j)
                    now = lang
                flush(i, run_, now)
            rows = pa.array(out.pop("row"), pa.int32())
            kinds = {"char_start": pa.int32(), "char_end": pa.int32(), "lang": pa.string(), "confidence": pa.float64(), "ambiguous": pa.bool_(), "sentences": pa.int32()}
            yield pa.RecordBatch.from_arrays(
                [docs.take(rows), batch.column(2).take(rows), *[pa.array(out[c], t) for c, t in kinds.items()]],
                names=["doc_id", "label", *kinds],
            )

    return run


def segments(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, label, char_start, char_end, lang, confidence, ambiguous, sentences).

    One row per stretch of one language; ``sentences`` counts the whole sentences
    told with certainty. Null, empty and wordless texts give no row.
    """
    model = model or fit(documents)
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = spread(documents.where("text is not null and doc_id is not null").select("doc_id", "text", F.col("lang").alias("label")))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_label(shared), f"doc_id {kind}, label string, {SEGMENTS}")


def labels(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, label, lang, confidence, languages, is_missing, is_wrong, is_mixed) for each document with words.

    ``lang`` is the language of most of the text, ties going to the first by
    name; ``languages`` are those with at least one whole sentence.
    """
    own = F.when(F.col("sentences") > 0, F.col("lang"))
    by_lang = segments(documents, model).groupBy("doc_id", "label", "lang").agg(
        F.sum(F.col("char_end") - F.col("char_start")).alias("chars"),
        F.avg("confidence").alias("confidence"),
        F.max(own).alias("own"),
    )
    rows = by_lang.groupBy("doc_id", "label").agg(
        F.max_by(F.struct("lang", "confidence"), F.struct("chars", "lang")).alias("top"), F.array_sort(F.collect_set("own")).alias("languages")
    )
    known = normal_label(F.col("label"))
    out = rows.select(
        "doc_id", "label", F.col("top.lang").alias("lang"), F.round("top.confidence", 4).alias("confidence"), "languages",
        known.isNull().alias("is_missing"), F.coalesce(~F.array_contains("languages", known) & (F.size("languages") > 0), F.lit(False)).alias("is_wrong"),
        (F.size("languages") > 1).alias("is_mixed"),
    )
    return out


def found(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, lang) of every document whose label is missing or wrong or whose text mixes languages."""
    cases = labels(documents, model).where("is_missing or is_wrong or is_mixed")
    return cases.select("doc_id", F.explode("languages").alias("lang")).distinct()
