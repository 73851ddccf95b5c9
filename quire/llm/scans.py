"""Problem 2: readable paragraphs from scanned pages.

1. Texts are brought to one form (problem 3), then words cut at a line end are
   joined where the vocabulary knows the joined word better than the hyphenated
   one.
2. The vocabulary is every word of the corpus with the number of blocks that
   hold it. A word that is rare against a look-alike, or less common and in the
   same context, is a misread: candidates
   come from the Levenshtein automaton with recognition confusions intersected
   with the vocabulary trie, and several candidates are ranked by the words
   beside them. A word that no confusion explains takes a look-alike an ordinary
   edit away where both sides of its places say so.
3. Running heads and page numbers are removed, lines are flowed into paragraphs
   and a word cut at the end of a block is joined with the block that continues it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from quire.llm.automaton import PLAIN_STEP, STEP, edited, reach, search, trie
from quire.llm.scripts import canonical_text
from quire.session import durable, sized_broadcast, spread, stored

LETTERS = r"a-zA-ZÀ-ÖØ-öø-ɏЀ-ӿ"
WORD = rf"[{LETTERS}0-9]+"
#: A cut: letters, hyphen or line-cut mark, white space, letters.
CUT = rf"([{LETTERS}]+)(?:[-¬­][ \t]*[\r\n]+\s*|- )([{LETTERS}]+)"
#: Cheap test that comes before the patterns above.
CUT_MARK = r"[-¬­]\s"
CUT_AT_END = rf"[{LETTERS}][-¬­]\s*$"
# Words that may follow a suspended hyphen ("low- and high-").
SUSPENDED = ["and", "or", "und", "oder", "bzw", "et", "ou", "y", "o", "e", "u", "и", "или", "to", "as", "sowie"]

# Words a title leaves in lower case.
TITLE_SMALL = ["a", "al", "an", "and", "at", "by", "et", "for", "from", "in", "of", "on", "or", "the", "to", "under", "via", "with"]

#: A word is a misread if its look-alike is in this many times more blocks; below, its context has to say so.
RATIO = 20
#: Letters of the three words that two look-alikes share for a context to count; fewer are common phrases.
CONTEXT_LETTERS = 12
#: Kinds of places; those from AROUND on stand on both sides of the word.
AUTHOR, BEHIND, BEFORE, AROUND, LEFT, RIGHT = 0, 1, 2, 3, 5, 6
#: Vocabulary words of one trie; more words make more tries.
TRIE_WORDS = 200_000
#: Tokens looked up by one task against one trie.
TASK_TOKENS = 200_000
#: Corrections are broadcast up to this many rows (about 100 bytes each), joined by shuffle beyond.
BROADCAST_ROWS = 300_000

PAGE_NUMBER = (
    r"(?:\[\s*[0-9lIOoSnB]{1,5}\s*\]|[-–—] ?[0-9lIOoSnB]{1,5} ?[-–—]|[0-9]{1,5} ?/ ?[0-9lIOoSnB]{1,5}|[0-9]{1,4}"
    r"|[Pp][A-Za-z0-9]{2}[A-Za-z] [0-9lIOoSnB]{1,5} \S{2} [0-9lIOoSnB]{1,5}|PAGE [0-9lIOoSnB]{1,5} OF [0-9lIOoSnB]{1,5})"
)
PAGE_LINE = rf"^\s*{PAGE_NUMBER}\s*$"
TAIL = rf"(?:^{PAGE_NUMBER}\s+|\s+{PAGE_NUMBER}$)"


# ---------------------------------------------------------------- page furniture


def head_like(line: Column) -> Column:
    """Whether a line has the form of a running head, by its letters alone.

    Every word of four or more letters starts with a capital (or a digit misread
    for one), there are at least two of them, and the line does not end a sentence.
    """
    longer = F.regexp_extract_all(line, F.lit(r"(?<![\p{L}0-9-])([\p{L}0-9]{4,})"), 1)
    capital = F.filter(longer, lambda w: w.rlike(r"^[\p{Lu}0-9]"))
    lettered = F.filter(longer, lambda w: w.rlike(r"^\p{Lu}"))
    journal = line.rlike(r"^(?:\p{Lu}[\p{L}0-9]*\.? ?){1,6} [0-9]{1,4} \([0-9]{1,3}\)$")
    small = F.filter(F.regexp_extract_all(line, F.lit(r"(?<![\p{L}0-9-])(\p{Ll}+)"), 1), lambda w: ~w.isin(TITLE_SMALL))
    title = (F.size(longer) >= 2) & (F.size(capital) == F.size(longer)) & (F.size(lettered) * 2 > F.size(longer)) & (F.size(small) == 0)
    return journal | (title & ~line.rlike(r"[.!?;,。]$|\[[0-9]+\]\.?$|^(Figure|Fig\.|Table|Tab\.|Section|Eq\.) "))


def head_key(line: Column) -> Column:
    """Key under which the same head on several pages meets: no case, digits or page number."""
    bare = F.regexp_replace(F.trim(line), TAIL, "")
    return F.regexp_replace(F.lower(bare), r"[^\p{L}]+", "")


def furniture(blocks: DataFrame, text: str = "text") -> DataFrame:
    """Lines that are running heads or page numbers: (block_id, line, is_block).

    A page number is known by its form; a head by its form, or because the same
    line (without case, digits and page number) stands on at least two pages of
    its version. Only single-line TEXT blocks and lines of several-line blocks
    are tested. Null texts and empty lines give no row.
    """
    lines = (
        blocks.where(
            (F.col("block_type") == "TEXT")
            & (F.col(text).contains("\n") | ((F.length(text) <= 110) & ~F.col(text).rlike(r"[㐀-鿿]")))
        )
        .select("block_id", "paper_version_id", "page", F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line", "said"))
        .withColumn("said", F.trim("said"))
        .where((F.col("said") != "") & (F.length("said") <= 110))
        .withColumn("bare", F.trim(F.regexp_replace("said", TAIL, "")))
        .withColumn("key", head_key(F.col("said")))
        .withColumn("by_form", F.col("said").rlike(PAGE_LINE) | head_like(F.col("bare")))
    )
    repeated = (
        lines.where((F.length("key") >= 12) & ~F.col("said").rlike(r"[.!?]$"))
        .groupBy("paper_version_id", "key")
        .agg(F.count_distinct("page").alias("pages"))
        .where("pages >= 2")
    )
    found = lines.join(repeated, ["paper_version_id", "key"], "left")
    return found.where(F.col("by_form") | F.col("pages").isNotNull()).select("block_id", "line", "said").distinct()


# ---------------------------------------------------------------- vocabulary and cuts


def words_in(text: Column) -> Column:
    """The lower-case words of a text in order, one blank between."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1), " ")


def _said() -> Column:
    return F.split(F.when(F.col("said") != "", F.col("said")), " ")


def vocabulary(ready: DataFrame) -> DataFrame:
    """(word, blocks): every word of prepared blocks and the number of blocks that hold it."""
    return ready.select(F.explode(F.array_distinct(_said())).alias("word")).groupBy("word").agg(F.count("*").alias("blocks"))


def cuts(blocks: DataFrame, words: DataFrame, text: str = "text") -> DataFrame:
    """Cut words: (block_id, head, tail) where the joined word beats the hyphenated one.

    ``low- and high-`` is no cut. ``fine-`` + ``grained`` at a line end is an
    ordinary hyphen when the corpus has ``fine-grained`` more often than
    ``finegrained``. A hyphen before a plain space needs the joined word in the
    vocabulary, or a second part that is no word of its own.
    """
    pairs = (
        blocks.where(F.col(text).rlike(CUT_MARK) & F.col(text).rlike(CUT))
        .select(
            "block_id",
            F.explode(
                F.arrays_zip(
                    F.regexp_extract_all(text, F.lit(CUT), 1).alias("head"), F.regexp_extract_all(text, F.lit(CUT), 2).alias("tail")
                )
            ).alias("p"),
        )
        .select("block_id", F.col("p.head").alias("head"), F.col("p.tail").alias("tail"))
        .where(~F.lower("tail").isin(SUSPENDED) & F.col("tail").rlike(r"^\p{Ll}"))
        .distinct()
        .withColumn("joined", F.lower(F.concat("head", "tail")))
        .withColumn("compound", F.lower(F.concat_ws("-", "head", "tail")))
    )
    compounds = (
        blocks.where(F.col(text).rlike(rf"[{LETTERS}]-[{LETTERS}]"))
        .select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"([{LETTERS}]+-[{LETTERS}]+)"), 1))).alias("compound"))
        .groupBy("compound")
        .agg(F.count("*").alias("as_compound"))
    )
    known = words.select(F.col("word").alias("joined"), F.col("blocks").alias("as_word"))
    tails = words.select(F.lower("word").alias("own"), F.col("blocks").alias("as_tail"))
    tested = (
        pairs.join(known, "joined", "left")
        .join(compounds, "compound", "left")
        .join(tails, F.lower(pairs["tail"]) == F.col("own"), "left")
        .fillna(0, ["as_word", "as_compound", "as_tail"])
    )
    better = F.col("as_word") >= F.col("as_compound")
    # Two words that merely lost the rest of "low- and high-": their join is all but unknown, the second is common.
    two_words = F.col("as_tail") >= 50 * F.greatest("as_word", F.lit(1))
    return tested.where(better & ~two_words).select("block_id", "head", "tail")


def join_cuts(text: Column) -> Column:
    """Join every cut word of a text whose second part starts in lower case."""
    tail = rf"(?!(?:{'|'.join(SUSPENDED)})(?![{LETTERS}]))(?=\p{{Ll}})"
    joined = F.regexp_replace(text, rf"(?:[-¬­][ \t]*[\r\n]+\s*|- )(?<=[{LETTERS}][-¬­]\s{{1,20}}){tail}", "")
    return F.when(text.rlike(CUT_MARK), joined).otherwise(text)


# ---------------------------------------------------------------- misread words


def _shards(lengths: list[tuple[int, int, int]]) -> dict[int, tuple[int, int]]:
    """Tries and token slices for each word length, from the counts of that length."""
    return {n: (-(-known // TRIE_WORDS) or 1, -(-rare // TASK_TOKENS) or 1) for n, known, rare in lengths}


def _look_up(key, tokens: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    rows = []
    if len(tokens) and len(known):
        freq = dict(zip(known["known_word"], known["known_blocks"]))
        root = trie(freq)
        most, least = max(freq.values()), RATIO * min(tokens["blocks"])
        common = [word for word, blocks in freq.items() if blocks >= least]
        ahead, back = trie(common), trie(word[::-1] for word in common)
        span = {bound: tuple(1 + n for n in reach(bound - PLAIN_STEP)) for bound in (2 * STEP, 3 * STEP)}
        for token, n in zip(tokens["word"], tokens["blocks"]):
            digit = any(ch.isdigit() for ch in token)
            bound = (3 if len(token) >= 8 else 2) * STEP
            confused = [(word, cost) for word, cost in search(root, token, bound).items() if word != token and (freq[word] >= n * 2 if digit else freq[word] > n)]
            rows += [(token, word, cost, freq[word], digit or freq[word] >= n * RATIO, False) for word, cost in confused]
            shorter, longer = span[bound]
            # A word with a digit at an end is a name or carries a mark; one that a confusion explains needs no ordinary edit.
            if confused or most < n * RATIO or token[0].isdigit() or token[-1].isdigit() or not -shorter <= key[0] - len(token) <= longer:
                continue
            rows += [(token, word, cost, freq[word], False, True) for word, cost in edited(ahead, back, token, bound).items() if word != token and freq[word] >= n * RATIO]
    return pd.DataFrame(rows, columns=["token", "word", "cost", "blocks", "sure", "edit"])


def corrections(words: DataFrame) -> DataFrame:
    """(token, word, cost, blocks, sure, edit): every commoner look-alike of each word; ``sure`` where the counts alone decide.

    ``edit`` marks those that take an ordinary edit; they are in ``RATIO`` times more
    blocks, never sure, and of use only for tokens without a look-alike by confusions.
    Words and tokens meet by word length: a token goes to the lengths its
    confusions can reach. Each length is cut into tries of a bounded number of
    words and slices of a bounded number of tokens, from counts per length, so
    neither a task's trie nor its tokens grow with the data. Tokens shorter than
    four letters, of which most are right words one confusion apart, and numbers are left alone.
    """
    apt = words.where((F.length("word") >= 4) & F.col("word").rlike(r"[^0-9]"))
    apt = apt.withColumn("n", F.length("word"))
    known = apt.where((F.col("blocks") >= 2) & ~F.col("word").rlike("[0-9]"))
    counts = {r["n"]: (r["known"], r["rare"]) for r in apt.groupBy("n").agg(
        F.count_if((F.col("blocks") >= 2) & ~F.col("word").rlike("[0-9]")).alias("known"), F.count("*").alias("rare")).collect()}
    shorter, longer = reach(3 * STEP, plain=True)
    shards = _shards([(n, k, sum(counts.get(m, (0, 0))[1] for m in range(n - longer, n + shorter + 1))) for n, (k, _) in counts.items() if k])
    if not shards:
        return words.sparkSession.createDataFrame([], "token string, word string, cost int, blocks long, sure boolean, edit boolean")
    plan = words.sparkSession.createDataFrame([(n, a, b) for n, (a, b) in shards.items()], "target int, tries int, slices int")
    most = apt.agg(F.max("blocks")).first()[0] or 0
    rare = apt.where((F.col("blocks") < most) & ~F.col("word").rlike("[0-9]") | (F.col("word").rlike("[0-9]") & (F.col("blocks") * 2 <= most)))
    rare = rare.withColumn("target", F.explode(F.sequence(F.col("n") - shorter, F.col("n") + longer))).join(F.broadcast(plan), "target")
    rare = rare.withColumn("slice", F.pmod(F.xxhash64("word"), F.col("slices").cast("long"))).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("tries") - 1)))
    known = known.withColumn("target", F.col("n")).join(F.broadcast(plan), "target")
    known = known.withColumn("t", F.pmod(F.xxhash64("word"), F.col("tries")).cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("slices") - 1).cast("long"))))
    pick = ["target", "t", "slice", "word", "blocks"]
    return (
        rare.select(*pick)
        .groupBy("target", "t", "slice")
        .cogroup(known.select(*[F.col(c).alias(f"known_{c}") for c in pick]).groupBy("known_target", "known_t", "known_slice"))
        .applyInPandas(_look_up, "token string, word string, cost int, blocks long, sure boolean, edit boolean")
    )


def _placed(ready: DataFrame, words: DataFrame, far: int) -> DataFrame:
    """Every place of the words ``w`` with the ``far`` words before it (l1 is the nearest) and behind it (r1)."""
    seq = F.col("s")
    before = [F.concat(F.array_repeat(F.lit(""), k), seq).alias(f"l{k}") for k in range(1, far + 1)]
    behind = [F.slice(seq, k + 1, 10_000_000).alias(f"r{k}") for k in range(1, far + 1)]
    every = ready.select(_said().alias("s")).select(F.explode(F.arrays_zip(seq.alias("w"), *before, *behind)).alias("z"))
    return every.where(F.length("z.w") >= 4).select("z.*").join(words, "w")


def _sign(kind: int, when: Column, *names: str) -> Column:
    return F.when(when, F.struct(F.lit(kind).cast("byte").alias("kind"), F.xxhash64(*names).alias("sign")))


def _beside(kind: int, when: Column, *names: str) -> Column:
    long_enough = sum((F.length(c) for c in names[1:]), F.length(names[0])) >= CONTEXT_LETTERS
    for c in names:
        long_enough = long_enough & (F.length(c) > 0)
    return _sign(kind, when & long_enough, *names)


def _around(when: Column) -> list[Column]:
    return [_beside(AROUND, when, "l1", "r1", "r2"), _beside(AROUND + 1, when, "l2", "l1", "r1")]


def places(every: DataFrame, ready: DataFrame, edits: DataFrame) -> DataFrame:
    """(w, kind, sign, n): the places of every word that takes part in an open or ambiguous candidate, and their number.

    One pass over the texts serves both uses. For words of candidates that counts
    leave open: standing as the author of ``... et al``, and the three words before,
    behind or around, ``CONTEXT_LETTERS`` letters at least. For tokens of ``edits``: the
    three words around alone. For misread tokens with
    several look-alikes and these: the word on either side. A sign is a hash of those words.
    """
    several = every.groupBy("token").agg(F.count_distinct(F.when(F.col("sure"), F.col("word"))).alias("n"))
    unclear = F.col("sure") & (F.col("n") > 1)
    no = F.lit(False)
    roles = every.join(several, "token").select(F.explode(F.array("token", "word")).alias("w"), (F.col("n") == 0).alias("open"), unclear.alias("unclear"), no.alias("edit"))
    roles = roles.union(edits.select(F.col("token").alias("w"), no.alias("open"), no.alias("unclear"), F.lit(True).alias("edit")))
    wanted = durable(roles.groupBy("w").agg(*[F.max(c).alias(c) for c in ("open", "unclear", "edit")]).where("open or unclear or edit"))
    rows = wanted.count()
    if not rows:
        return wanted.select("w", F.lit(0).cast("byte").alias("kind"), F.lit(0).cast("long").alias("sign"), F.lit(0).cast("long").alias("n"))
    there = _placed(ready, sized_broadcast(wanted, BROADCAST_ROWS, rows), 3)
    open_ = F.col("open")
    author = _sign(AUTHOR, open_ & (F.col("r1") == "et") & (F.col("r2") == "al"), "r1", "r2")
    signs = [author, _beside(BEHIND, open_, "r1", "r2", "r3"), _beside(BEFORE, open_, "l3", "l2", "l1"), *_around(open_ | F.col("edit"))]
    signs += [_sign(LEFT, F.col("unclear"), "l1"), _sign(RIGHT, F.col("unclear"), "r1")]
    seen = there.select("w", F.explode(F.array(*signs)).alias("s")).where("s is not null").select("w", "s.kind", "s.sign")
    return durable(seen.groupBy("w", "kind", "sign").agg(F.count("*").alias("n")))


def told_by_context(candidates: DataFrame, signs: DataFrame) -> DataFrame:
    """The candidates (token, word, cost, blocks) that the places of both words make misreads whatever their counts.

    Both stand as an author, or beside the same three words (:func:`places`). A
    token with several look-alikes needs three words around it, and takes none if
    those fit more than one.
    """
    own = signs.where(F.col("kind") < LEFT).select("w", "kind", "sign")
    many = candidates.groupBy("token").agg(F.count_distinct("word").alias("n"))
    shared = (
        candidates.select("token", "word").distinct()
        .join(own.withColumnRenamed("w", "token"), "token")
        .join(own.withColumnRenamed("w", "word"), ["word", "kind", "sign"])
        .groupBy("token", "word").agg(F.max(F.col("kind") >= AROUND).alias("within"))
        .join(many, "token")
        .where("n = 1 or within")
    )
    clear = shared.groupBy("token").agg(F.count("*").alias("fits"), F.first("word").alias("word")).where("fits = 1").select("token", "word")
    return candidates.join(clear, ["token", "word"], "left_semi")


def told_by_sides(edits: DataFrame, signs: DataFrame, ready: DataFrame) -> DataFrame:
    """The look-alikes by an ordinary edit (token, word, cost, blocks) that make a token a misread.

    Such an edit is also what tells two right words apart, one form of a word from another
    or two languages, so one shared place is not enough: over half of the token's places
    by the words on both sides (:func:`places`) are those of the word, and of no second one.
    The words are common, so of their places only those that some token has leave the texts.
    """
    pairs = edits.select("token", "word").distinct()
    of_token = signs.where(F.col("kind").between(AROUND, LEFT - 1)).select(F.col("w").alias("token"), "kind", "sign", "n")
    of_token = durable(of_token.join(pairs.select("token").distinct(), "token", "left_semi"))
    words = durable(pairs.join(of_token.select("token").distinct(), "token", "left_semi").select(F.col("word").alias("w")).distinct())
    if words.isEmpty():
        return edits.limit(0)
    wanted = sized_broadcast(durable(of_token.select("kind", "sign").distinct()))
    there = _placed(ready, sized_broadcast(words, BROADCAST_ROWS), 2).select("w", F.explode(F.array(*_around(F.lit(True)))).alias("s"))
    of_word = there.where("s is not null").select(F.col("w").alias("word"), "s.kind", "s.sign").join(wanted, ["kind", "sign"], "left_semi").distinct()
    every = of_token.groupBy("token").agg(F.sum("n").alias("every"))
    shared = (
        pairs.join(of_token, "token")
        .join(of_word, ["word", "kind", "sign"])
        .groupBy("token", "word").agg(F.sum("n").alias("shared"))
        .join(every, "token").where(F.col("shared") * 2 > F.col("every"))
    )
    clear = shared.groupBy("token").agg(F.count("*").alias("fits"), F.first("word").alias("word")).where("fits = 1").select("token", "word")
    return edits.join(clear, ["token", "word"], "left_semi")


def ranked_by_context(candidates: DataFrame, signs: DataFrame) -> DataFrame:
    """(token, word): one correction for each misread token.

    A token with several look-alikes takes the one its neighbours prefer: the
    places in which the word stands beside a neighbour of the token, then the
    least cost, then the commonest word, then the last by code point.
    """
    candidates = durable(candidates.groupBy("token", "word").agg(F.min("cost").alias("cost"), F.max("blocks").alias("blocks")))
    many = candidates.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    sides = signs.where(F.col("kind") >= LEFT)
    of_token = candidates.join(many, "token", "left_semi").join(sides.select(F.col("w").alias("token"), "kind", "sign"), "token")
    beside = of_token.join(sides.select(F.col("w").alias("word"), "kind", "sign", "n"), ["word", "kind", "sign"]).groupBy("token", "word").agg(F.sum("n").alias("support"))
    best = F.struct(F.coalesce("support", F.lit(0)).alias("a"), (-F.col("cost")).alias("b"), F.col("blocks").alias("c"), F.col("word").alias("d"))
    return candidates.join(beside, ["token", "word"], "left").groupBy("token").agg(F.max_by("word", best).alias("word"))


def prepared(blocks: DataFrame) -> DataFrame:
    """Blocks with ``plain`` (one character form) for their text and ``said`` (its words, cuts joined), written once.

    Every later step scans these columns, so the character work and the search for
    words are done once.
    """
    plain = spread(blocks).withColumn("plain", canonical_text(F.col("text"))).drop("text")
    return stored(plain.withColumn("said", words_in(join_cuts(F.col("plain")))))


def misread_words(ready: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(token, word): the corpus's misread words, each with its correction."""
    words = words if words is not None else durable(vocabulary(ready))
    columns = ["token", "word", "cost", "blocks"]
    found_ = durable(corrections(words))
    every = found_.where("not edit")
    edits = durable(found_.where("edit").join(every.select("token").distinct(), "token", "left_anti"))
    signs = places(every, ready, edits)
    sure = every.where("sure").select(*columns)
    open_ = every.join(sure.select("token").distinct(), "token", "left_anti").select(*columns)
    told = told_by_context(durable(open_), signs).select(*columns).union(told_by_sides(edits, signs, ready).select(*columns))
    return ranked_by_context(sure.union(told), signs)


def found(blocks: DataFrame) -> DataFrame:
    """(block_id, kind): every block and kind of noise in its text.

    Null texts give no row, repeated rows one; extra columns are ignored.
    """
    need = ["block_id", "paper_version_id", "page", "block_type", "text"]
    ready = prepared(blocks.where(F.col("block_id").isNotNull() & F.col("text").isNotNull()).select(*need))
    words = durable(vocabulary(ready))
    wrong = durable(misread_words(ready, words))
    wrong = durable(wrong.select(F.col("token").alias("w")))
    wrong = sized_broadcast(wrong, BROADCAST_ROWS)
    misread = ready.select("block_id", F.explode(F.array_distinct(_said())).alias("w")).join(wrong, "w", "left_semi").select("block_id")
    at_end = ready.where(F.col("plain").rlike(CUT_AT_END)).select("block_id")
    hyphen = cuts(ready, words, "plain").select("block_id").union(at_end)
    heads = furniture(ready, "plain").select("block_id")
    return (
        hyphen.select("block_id", F.lit("hyphen").alias("kind"))
        .union(misread.select("block_id", F.lit("misread").alias("kind")))
        .union(heads.select("block_id", F.lit("furniture").alias("kind")))
        .distinct()
    )


# ---------------------------------------------------------------- repaired text


@F.pandas_udf(StringType())
def _mend(texts: pd.Series, fixes: pd.Series) -> pd.Series:
    import re

    word = re.compile(WORD)

    def one(text, pairs):
        if text is None or pairs is None or not len(pairs):
            return text
        by = {p["token"]: p["word"] for p in pairs}

        def put(m):
            said = m.group()
            good = by.get(said.lower())
            if good is None:
                return said
            if said.isupper() and len(said) > 1:
                return good.upper()
            first = next((ch for ch in said if ch.isalpha()), "")
            return good[:1].upper() + good[1:] if first.isupper() or said[:1].isdigit() and said[1:2].isupper() else good

        return word.sub(put, text)

    return pd.Series([one(t, f) for t, f in zip(texts, fixes)])


def fixes_by_block(ready: DataFrame, wrong: DataFrame) -> DataFrame:
    """(block_id, fixes): the corrections each block needs; blocks without any are absent."""
    pairs = sized_broadcast(wrong, BROADCAST_ROWS)
    hits = ready.select("block_id", F.explode(F.array_distinct(_said())).alias("token")).join(pairs, "token").distinct()
    return hits.groupBy("block_id").agg(F.collect_list(F.struct("token", "word")).alias("fixes"))


def _continued(ends: DataFrame, mended: DataFrame) -> DataFrame:
    """(cut_id, next_id, moved): the block that continues each cut and its first word.

    Looked up by its place, never by sorting a version: in the next four places,
    and where no text stands there (figures, tables and page furniture between) in
    ever wider stretches to the end of the version. In the first stretch with text
    the nearest block that begins in lower case continues the word.
    """
    texts = durable(mended.where("block_type = 'TEXT'").select("paper_version_id", "block_index", "block_id", F.regexp_extract("paragraph", r"^(\p{Ll}\S*)", 1).alias("word")))
    last = texts.groupBy("paper_version_id").agg(F.max("block_index").alias("last"))
    open_ = durable(ends.select("paper_version_id", F.col("block_id").alias("cut_id"), "block_index").join(last, "paper_version_id"))
    out, lo, hi = None, 1, 4
    while True:
        ahead = open_.select("paper_version_id", "cut_id", F.explode(F.sequence(F.col("block_index") + lo, F.col("block_index") + hi)).alias("block_index"))
        near = F.struct(F.col("block_id").alias("next_id"), F.col("word").alias("moved"))
        hits = durable(ahead.join(texts, ["paper_version_id", "block_index"]).groupBy("cut_id").agg(F.min_by(F.when(F.col("word") != "", near), F.when(F.col("word") != "", F.col("block_index"))).alias("n")))
        some = hits.where("n is not null").select("cut_id", "n.next_id", "n.moved")
        out = some if out is None else out.unionByName(some)
        open_ = durable(open_.where(F.col("block_index") + hi < F.col("last")).join(hits.select("cut_id"), "cut_id", "left_anti"))
        if open_.isEmpty():
            return durable(out)
        lo, hi = hi + 1, hi * 4


def paragraphs(blocks: DataFrame) -> DataFrame:
    """The clean paragraphs of each version, one row per block that keeps text.

    (block_id, paper_version_id, page, block_index, block_type, paragraph). Page furniture is
    dropped, cut words are joined (also with the block that continues them, whose
    first word then moves up), misread words are corrected and line breaks become
    spaces. Of repeated block ids the last ingested row counts. Null and empty
    texts give no paragraph.
    """
    from quire.sources.tables import latest

    need = ["block_id", "paper_version_id", "page", "block_index", "block_type", "text", "ingested_at"]
    own = latest(blocks.where(F.col("block_id").isNotNull() & F.col("text").isNotNull()).select(*need), "block_id")
    ready = prepared(own)
    wrong = durable(misread_words(ready))
    heads = furniture(ready, "plain").groupBy("block_id").agg(F.collect_set("line").alias("drop"))
    fixes = fixes_by_block(ready, wrong)
    body = ready.join(heads, "block_id", "left").join(fixes, "block_id", "left")
    lines = F.split("plain", r"\r?\n")
    kept = F.when(F.col("drop").isNull(), F.col("plain")).otherwise(
        F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("drop"), i)), "\n")
    )
    flowed = F.trim(F.regexp_replace(join_cuts(kept), r"\s+", " "))
    body = body.withColumn("flowed", flowed).where("flowed != ''")
    mended = body.withColumn("paragraph", F.coalesce(_mend(F.col("flowed"), F.col("fixes")), F.col("flowed")))
    mended = durable(mended.select("block_id", "paper_version_id", "page", "block_index", "block_type", "paragraph"))
    ends = mended.where(F.col("paragraph").rlike(CUT_AT_END) & (F.col("block_type") == "TEXT"))
    nexts = _continued(ends, mended)
    first = nexts.select(F.col("cut_id").alias("block_id"), "moved")
    second = nexts.groupBy(F.col("next_id").alias("block_id")).agg(F.lit(True).alias("shortened"))
    out = mended.join(first, "block_id", "left").join(second, "block_id", "left")
    text = F.when(F.col("shortened"), F.regexp_replace("paragraph", r"^\S+\s*", "")).otherwise(F.col("paragraph"))
    text = F.when(F.col("moved").isNotNull(), F.concat(F.regexp_replace(text, r"[-¬­]\s*$", ""), F.col("moved"))).otherwise(text)
    return out.withColumn("paragraph", text).where("paragraph != ''").drop("moved", "shortened")
