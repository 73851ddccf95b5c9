"""Problem 9: a mixture of sources with given shares of all tokens.

A classifier trained on the labelled table gives every document a posterior over
the domains; its source label is evidence beside the text and weighs as much as
labels hold against a certain classifier on held-out documents. Nonnegative document rates, at
most each source's repeat cap, are fitted by projected gradient least squares so
that the expected tokens of every domain meet its target; the update of a document
depends on its membership and cap only, so the passes run on groups of equal
membership. Rates become repeat counts by a seeded hash. The shares that come out,
expected and actual, are reported beside the targets.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire.session import durable, hash_sample, spread, stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Labelled documents per source that the classifier is trained on, at most.
SAMPLE_DOCS = 300
DIM, EPOCHS, SEED = 1 << 15, 3, 29
#: A posterior that contradicts a label.
CERTAIN = 0.95
#: Steps of membership; documents of equal steps share one rate.
STEPS = 100
#: The fit ends when every domain is this near its target, or when PATIENCE passes in a row bring it less than a hundredth nearer.
CLOSE_ENOUGH, PATIENCE = 1e-4, 8
#: Groups of equal membership that are fitted in one task (about 100 bytes each); more are fitted in distributed passes.
LOCAL_GROUPS = 100_000

_WORD = re.compile(r"[^\W\d_]+|[㐀-鿿]")


def counter(path: str):
    """Token counter of a public byte-level vocabulary file."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
    return tiktoken.Encoding("mixing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def shape(text: str) -> list[str]:
    """Signs of a text's form: how many lines it has, how long it is, and which share of its lines begins in which way."""
    lines = [x for x in text.split("\n") if x.strip()]
    out = [f"#lines{int(math.log2(len(lines) + 1) * 2)}", f"#size{int(math.log2(len(text) + 1) * 2)}"]
    heads: dict[str, int] = {}
    for line in lines:
        head = re.match(r"\s*(?:[-*•]\s|\d+[.)]\s|[\w]+:\s|\[|>)", line)
        kind = re.sub(r"\d", "0", re.sub(r"[^\W\d_]+", "a", head.group().strip())) if head else "none"
        heads[kind] = heads.get(kind, 0) + 1
    for kind, n in heads.items():
        out += [f"#head{kind}", f"#head{kind}:{math.ceil(4 * n / len(lines))}"]
    return out


class Classifier:
    """Multinomial logistic regression over hashed words and form signs."""

    def __init__(self, weights: np.ndarray, names: list[str]):
        self.weights, self.names = weights, names
        self.at: dict[str, int] = {}

    def __getstate__(self):
        return self.weights, self.names

    def __setstate__(self, state):
        self.__init__(*state)

    def features(self, text: str) -> np.ndarray:
        if len(self.at) > 500_000:
            self.at.clear()
        out, at = [], self.at
        for w in _WORD.findall(text):
            i = at.get(w)
            if i is None:
                i = at[w] = zlib.crc32(w.lower().encode()) % DIM
            out.append(i)
        out = sorted(set(out))
        # The form of a text tells its source; it counts as much as all its words.
        signs = [zlib.crc32(s.encode()) % DIM for s in shape(text)]
        return np.array(out), np.array(signs)

    def scores(self, f) -> np.ndarray:
        words, signs = f
        s = self.weights[signs].sum(0) / math.sqrt(len(signs))
        return s + (self.weights[words].sum(0) / math.sqrt(len(words)) if len(words) else 0)

    def posterior(self, text: str) -> np.ndarray:
        s = self.scores(self.features(text))
        e = np.exp(s - s.max())
        return e / e.sum()


def _train(data: list, names: list[str]) -> Classifier:
    model = Classifier(np.zeros((DIM, len(names)), np.float32), names)
    rng = np.random.default_rng(SEED)
    for epoch in range(EPOCHS):
        for k in rng.permutation(len(data)):
            y, f = data[k]
            s = model.scores(f)
            e = np.exp(s - s.max())
            g = e / e.sum()
            g[y] -= 1
            step = np.float32(0.5 / (1 + epoch))
            for part in f:
                if len(part):
                    np.add.at(model.weights, part, (-step * g / math.sqrt(len(part))).astype(np.float32))
    return model


def _features(frames):
    model = Classifier(np.zeros((DIM, 1), np.float32), [])
    for pdf in frames:
        both = [model.features(t) for t in pdf["text"]]
        yield pdf[["doc_id", "home"]].assign(words=[w for w, _ in both], signs=[s for _, s in both])


def fit(documents: DataFrame, names: list[str], sample: int = SAMPLE_DOCS) -> tuple[Classifier, float]:
    """(classifier, trust), trained on at most ``sample`` documents of each source, the first by a hash of the id.

    Only hashed features of the sample, at most ``DIM`` for a document, come to the
    driver. ``trust`` is the share of held-out labels that a classifier of the other
    half of the sample does not contradict with a posterior of ``CERTAIN``, smoothed.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    ids = hash_sample(documents.where("text is not null"), "source", "doc_id", names, sample, SEED)
    rows = documents.where("text is not null").join(F.broadcast(ids.select("doc_id", F.col("source").alias("home"))), "doc_id").where("source = home").select("doc_id", "home", "text")
    rows = rows.mapInPandas(_features, f"doc_id {kind}, home string, words array<int>, signs array<int>").distinct().orderBy("doc_id", "home").collect()
    data = [(names.index(r["home"]), (np.array(r["words"], np.int64), np.array(r["signs"], np.int64))) for r in rows]
    half = _train(data[::2], names)
    wrong = 0
    for y, f in data[1::2]:
        e = np.exp((s := half.scores(f)) - s.max())
        wrong += int(e.argmax()) != y and e.max() / e.sum() >= CERTAIN
    return _train(data, names), 1 - (wrong + 1) / (len(data[1::2]) + 2)


def _members(model, path: str, trust: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        place = {s: i for i, s in enumerate(m.names)}
        n = len(m.names)
        enc = counter(path)
        for batch in batches:
            texts, sources = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            tokens, steps, home = [], [], []
            for text, source in zip(texts, sources):
                tokens.append(len(enc.encode_ordinary(text)))
                p = m.posterior(text)
                i = place.get(source)
                if i is None:
                    i = int(p.argmax())
                elif n > 1:  # the label as evidence
                    said = np.full(n, (1 - trust) / (n - 1))
                    said[i] = trust
                    p = p * said
                    p = p / p.sum()
                q = np.floor(p * STEPS + 0.5).astype(np.int16)
                steps.append(q.tolist())
                home.append(m.names[i])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(home), pa.array(tokens, pa.int64()), pa.array(steps, pa.list_(pa.int16()))],
                names=["doc_id", "source", "home", "tokens", "steps"],
            )

    return run


def memberships(documents: DataFrame, names: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, home, tokens, steps), written once.

    ``home`` is the source, or the likeliest one where the source is missing or not
    among the targets; ``steps`` is the membership in each domain. Null texts give
    no row, empty texts no tokens; a repeated document counts as often as it stands.
    """
    model, trust = fit(documents.where("doc_id is not null"), names)
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "source", "text"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    out = docs.mapInArrow(_members(shared, tokenizer, trust), f"doc_id {kind}, source string, home string, tokens long, steps array<short>")
    return stored(out)


def mixture(documents: DataFrame, source_targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, home, tokens, rate, repeats) of every document with text.

    The total is the largest that no domain's expected tokens, repeated to the caps,
    forbid. ``repeats`` never
    exceeds the source's ``max_repeats``; documents of sources without a target
    get the likeliest domain. Targets are taken in proportion when they do not
    sum to one; a target whose source has no tokens cannot be met and is left out.
    Without any target nothing is chosen.
    """
    spark = documents.sparkSession
    aims = source_targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).orderBy("source").collect()
    names = [r["source"] for r in aims]
    caps = {r["source"]: float(1 if r["cap"] is None else max(r["cap"], 0)) for r in aims}
    if not names:
        none = documents.where("doc_id is not null and text is not null").select("doc_id", "source")
        return none.select("*", F.lit(None).cast("string").alias("home"), F.lit(None).cast("long").alias("tokens"), F.lit(0.0).alias("rate"), F.lit(0).alias("repeats"))
    docs = memberships(documents, names, tokenizer)
    cap_of = F.create_map(*[x for s in names for x in (F.lit(s), F.lit(caps[s]))]) if names else F.lit(None)
    docs = docs.withColumn("cap", cap_of[F.col("home")])
    # Groups of equal membership and cap: as many as the steps allow, however many documents.
    groups = durable(docs.groupBy("home", "cap", "steps").agg(F.sum("tokens").alias("tokens")))
    n = len(names)
    few = groups.limit(LOCAL_GROUPS + 1).count() <= LOCAL_GROUPS
    held = groups.select("steps", "cap", "tokens").toArrow() if few else None

    def sums(history: list[list[float]], reach: list[float] | None):
        """One distributed pass: tokens per domain at the rates the history of gaps leads to."""

        def run(batches):
            total_, area = np.zeros(n), np.zeros(n)
            for b in batches:
                if not b.num_rows:
                    continue
                p, cap, tok = _arrays(b, n)
                area += (tok[:, None] * p * (1 if reach is not None else cap[:, None])).sum(0)
                if reach is not None:
                    total_ += (tok[:, None] * p * _replay(p, cap, history, reach, targets)[:, None]).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(total_), pa.array(area)], names=["k", "total", "area"])

        parts = [next(run(held.to_batches()))] if few else [groups.select("steps", "cap", "tokens").mapInArrow(run, "k int, total double, area double").toArrow()]
        out_total, out_area = np.zeros(n), np.zeros(n)
        for t in parts:
            np.add.at(out_total, t.column("k").to_numpy(), t.column("total").to_numpy())
            np.add.at(out_area, t.column("k").to_numpy(), t.column("area").to_numpy())
        return out_total, out_area

    _, most = sums([], None)
    live = {r["home"] for r in groups.where("tokens > 0").select("home").distinct().collect()}
    targets = np.array([r["share"] * (r["source"] in live) for r in aims]) * (most > 0)
    targets = targets / targets.sum() if targets.sum() else targets
    targets = targets * min((m / t for m, t in zip(most, targets) if t), default=0.0)
    _, area = sums([], [1.0] * n)
    reach = np.maximum(area, 1e-9).tolist()
    history: list[list[float]] = []
    best, since = np.inf, 0
    if few:
        p, cap, tok = _arrays(held.combine_chunks().to_batches()[0], n) if held.num_rows else (np.zeros((0, n)), np.zeros(0), np.zeros(0))
        rate = _replay(p, cap, [], reach, targets)
    while True:
        got = (tok[:, None] * p * rate[:, None]).sum(0) if few else sums(history, reach)[0]
        gap = got - targets
        far = float(np.abs(gap / np.maximum(targets, 1)).max())
        since = 0 if far < best * 0.99 else since + 1
        best = min(best, far)
        if far < CLOSE_ENOUGH or since >= PATIENCE:
            break
        history.append(gap.tolist())
        if few:
            rate = np.clip(rate - (p * (gap / np.array(reach))).sum(1), 0, cap)

    def rates(batches):
        for b in batches:
            p, cap, _ = _arrays(b, n)
            r = _replay(p, cap, history, reach, targets) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(1), b.column(0), pa.array(r)], names=["home", "cap", "steps", "rate"])

    fitted = durable(groups.select("steps", "cap", "tokens", "home").mapInArrow(rates, "home string, cap double, steps array<short>, rate double"))
    draw = (F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    rated = docs.join(fitted, ["home", "cap", "steps"]).withColumn("draw", draw)
    repeats = F.least(F.floor(F.col("rate") + F.col("draw")), F.col("cap")).cast("int")
    return rated.select("doc_id", "source", "home", "tokens", F.round("rate", 6).alias("rate"), repeats.alias("repeats"))


def _arrays(b: pa.RecordBatch, n: int):
    p = b.column(0).flatten().to_numpy().reshape(-1, n).astype(float)
    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    return p, b.column(1).to_numpy().astype(float), b.column(2).to_numpy().astype(float)


def _replay(p, cap, history, reach, targets):
    r = np.clip((p * (targets / np.array(reach))).sum(1), 0, cap)
    for gap in history:
        r = np.clip(r - (p * (np.array(gap) / np.array(reach))).sum(1), 0, cap)
    return r


def shares(documents: DataFrame, source_targets: DataFrame, tokenizer: str = TOKENIZER, mixed: DataFrame | None = None) -> DataFrame:
    """(source, target_share, expected_share, actual_share, gap, tokens, records, most_repeats) of every target.

    ``expected_share`` is what the fitted rates give the source, ``gap`` the actual
    share less the target.
    """
    mixed = mixed if mixed is not None else mixture(documents, source_targets, tokenizer)
    by = durable(
        mixed.groupBy(F.col("home").alias("source")).agg(
            F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.sum(F.col("tokens") * F.col("rate")).alias("expected"),
            F.sum("repeats").alias("records"), F.max("repeats").alias("most_repeats"),
        )
    )
    total = by.agg(F.sum("tokens").alias("all_tokens"), F.sum("expected").alias("all_expected"))
    aims = source_targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    out = aims.join(by, "source", "left").crossJoin(F.broadcast(total)).fillna(0, ["tokens", "expected", "records", "most_repeats"])
    actual = F.try_divide("tokens", "all_tokens")
    return out.select(
        "source", "target_share", F.round(F.try_divide("expected", "all_expected"), 6).alias("expected_share"), F.round(actual, 6).alias("actual_share"),
        F.round(actual - F.col("target_share"), 6).alias("gap"), "tokens", "records", "most_repeats",
    )
