"""Problem 3: one written form for text that looks alike.

Every token gets the intersection of its characters' script sets. An empty
intersection is a mixed-script token; a token wholly in one script whose every
letter has a twin in the script around it is a whole-script confusable. In both
cases the one script that can spell all of the token (or, where several can, the
script of most of its letters, then of its surroundings) is chosen and the odd
letters are replaced by their twins. What remains (compatibility forms, detached
accents, invisible characters, unusual spaces) is normalised.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

# Letters that share a shape, by script, each with its Latin twin.
CYRILLIC_TWINS = {
    "а": "a", "А": "A", "В": "B", "с": "c", "С": "C", "ԁ": "d", "е": "e", "Е": "E", "һ": "h", "Н": "H",
    "і": "i", "І": "I", "ј": "j", "Ј": "J", "К": "K", "ӏ": "l", "М": "M", "о": "o", "О": "O", "р": "p",
    "Р": "P", "ԛ": "q", "ѕ": "s", "Ѕ": "S", "Т": "T", "ѵ": "v", "ԝ": "w", "х": "x", "Х": "X", "у": "y",
    "У": "Y", "Ԍ": "G", "ү": "y", "Ү": "Y", "ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï",
}
GREEK_TWINS = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "α": "a", "ι": "i", "ν": "v", "ρ": "p", "υ": "u",
    "κ": "k", "ϲ": "c", "ϳ": "j",
}
#: Greek lower-case letters that stand alone as symbols; never rewritten on their own.
GREEK_SYMBOLS = set("αινρυκ")
SPACES = "   -   　"
INVISIBLE = "­᠎​-‏‪-‮⁠-⁤﻿"

LATIN, CYRILLIC, GREEK, HAN = 1, 2, 4, 8
ANY = 15
TO_LATIN = {**CYRILLIC_TWINS, **GREEK_TWINS}
# Only letters of living Cyrillic alphabets are written in place of Latin ones.
TO_CYRILLIC = {latin: own for own, latin in CYRILLIC_TWINS.items() if own in "аАВсСеЕНіІјЈКМоОрРТхХуУёЁїЇ"}
TO_CYRILLIC |= {g: TO_CYRILLIC[latin] for g, latin in GREEK_TWINS.items() if latin in TO_CYRILLIC}
TO_GREEK = {latin: own for own, latin in GREEK_TWINS.items() if own not in "ϲϳ"}
TO_GREEK |= {c: TO_GREEK[latin] for c, latin in CYRILLIC_TWINS.items() if latin in TO_GREEK}
TWINS = {LATIN: TO_LATIN, CYRILLIC: TO_CYRILLIC, GREEK: TO_GREEK}

_WORD = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(f"[{SPACES}]")
_HIDDEN = re.compile(f"[{INVISIBLE}]")
_MARK = re.compile("[̀-ͯ]")
_COMPAT = re.compile("[ﬀ-ﬆ０-９Ａ-Ｚａ-ｚ\U0001d400-\U0001d7ff]")
_WIDE_PUNCT = re.compile("[！-／：-＠［-｀｛-～]")
_ODD = re.compile("[Ͱ-ϿЀ-ԯ]")
_JOINED_SCRIPTS = re.compile("[֐-෿]")

# The JVM filter for texts that can change at all; everything else never leaves the JVM.
_TWIN_CLASS = "".join(TO_LATIN)
SUSPECT = (
    f"[{SPACES}{INVISIBLE}̀-ͯﬀ-ﬆ０-９Ａ-Ｚａ-ｚ\\x{{1D400}}-\\x{{1D7FF}}]"
    r"|\p{IsLatin}[\p{IsCyrillic}\p{IsGreek}]|[\p{IsCyrillic}\p{IsGreek}]\p{IsLatin}"
    r"|(?<!\p{L})[" + _TWIN_CLASS + r"]+(?!\p{L})"
)


@lru_cache(maxsize=4096)
def script(ch: str) -> int:
    """The script of a letter as a bit set; characters of no single script fit all."""
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o <= 0x1EFF:
        return LATIN if ch.isalpha() else ANY
    if 0x370 <= o <= 0x3FF or 0x1F00 <= o <= 0x1FFF:
        return GREEK if ch.isalpha() else ANY
    if 0x400 <= o <= 0x52F:
        return CYRILLIC
    if 0x3400 <= o <= 0x9FFF:
        return HAN
    return ANY


def _spell(word: str, target: int) -> str | None:
    """The word in one script, or None if a letter has no twin there."""
    twins = TWINS[target]
    out = []
    for ch in word:
        if script(ch) & target:
            out.append(ch)
        elif ch in twins:
            out.append(twins[ch])
        else:
            return None
    return "".join(out)


def resolve(word: str, around: dict[int, int]) -> str:
    """The consistent spelling of one token; ``around`` counts letters near it by script."""
    sets, own = ANY, {}
    for ch in word:
        s = script(ch)
        sets &= s
        if s != ANY:
            own[s] = own.get(s, 0) + 1
    if not sets:  # mixed scripts
        options = [(t, w) for t in (LATIN, CYRILLIC, GREEK) if (w := _spell(word, t)) is not None]
        options = [(t, w) for t, w in options if t in own]
        if not options or (len(word) == 2 and set(word) & GREEK_SYMBOLS):
            return word
        return max(options, key=lambda o: (around.get(o[0], 0) > 0, own[o[0]], around.get(o[0], 0), -o[0]))[1]
    if sets in (CYRILLIC, GREEK):  # whole-script confusables
        if len(word) == 1 and word in GREEK_SYMBOLS:
            return word
        latin = _spell(word, LATIN)
        if latin is not None and around.get(LATIN, 0) > 0 and not around.get(sets, 0):
            return latin
    elif sets == LATIN and around.get(CYRILLIC, 0) > 0 and not around.get(LATIN, 0):
        own_form = _spell(word, CYRILLIC)
        if own_form is not None and word.isascii() and (len(word) <= 2 or not word[1:].isupper()):
            return own_form
    return word


def _resolve_all(text: str) -> str:
    words = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]
    kinds = []
    for _, _, w in words:
        s = ANY
        for ch in w:
            s &= script(ch)
        kinds.append((s, len(w)))
    out, last = [], 0
    for i, (a, b, w) in enumerate(words):
        s = kinds[i][0]
        if s == HAN or s == ANY or not (s == LATIN or _ODD.search(w)) or (s == LATIN and w.isascii() and len(w) > 2 and not all(ch in TO_CYRILLIC for ch in w)):
            continue
        around: dict[int, int] = {}
        for j in (i - 2, i - 1, i + 1, i + 2):
            if 0 <= j < len(words) and kinds[j][0] in (LATIN, CYRILLIC, GREEK) and kinds[j][1] > 1:
                around[kinds[j][0]] = around.get(kinds[j][0], 0) + kinds[j][1]
        new = resolve(w, around)
        if new != w:
            out += [text[last:a], new]
            last = b
    return "".join(out) + text[last:] if out else text


def _compose(text: str) -> str:
    return unicodedata.normalize("NFC", text) if _MARK.search(text) else text


def _drop_hidden(m: re.Match) -> str:
    text, i = m.string, m.start()
    ch = m.group()
    if ch == "­" and re.match(r"\s*\n", text[i + 1 : i + 8]):
        return ch  # a line-cut mark, problem 2
    if ch in "‌‍" and i and _JOINED_SCRIPTS.match(text[i - 1]):
        return ch  # orthographic joiners
    return ""


def _wide_punct(m: re.Match) -> str:
    text = m.string
    before = next((script(ch) for ch in reversed(text[max(0, m.start() - 8) : m.start()]) if ch.isalpha()), None)
    after = next((script(ch) for ch in text[m.end() : m.end() + 2] if ch.isalpha()), None)
    near = [s for s in (before, after) if s]
    return unicodedata.normalize("NFKC", m.group()) if near and HAN not in near else m.group()


def canonical(text: str | None) -> str | None:
    """The one form of a text; null stays null, an empty text stays empty."""
    if not text:
        return text
    out = _HIDDEN.sub(_drop_hidden, text)
    out = _SPACE.sub(" ", out)
    out = _compose(out)
    if _COMPAT.search(out):
        out = _COMPAT.sub(lambda m: unicodedata.normalize("NFKC", m.group()), out)
        out = _WIDE_PUNCT.sub(_wide_punct, out)
    if _ODD.search(out):
        out = _resolve_all(out)
    return out


@F.pandas_udf(StringType())
def _canonical_udf(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore")


def suspect(text: Column) -> Column:
    """Whether the text holds anything the normaliser could change."""
    return text.rlike(r"[^\x00-\x7F]") & text.rlike(SUSPECT)


def canonical_text(text: Column) -> Column:
    """Column form of :func:`canonical`; only suspect texts travel to Python."""
    return F.coalesce(_canonical_udf(F.when(suspect(text), text)), text)


def consistent(df: DataFrame, text: str, into: str = "canonical", changed: str = "is_changed") -> DataFrame:
    """Add the consistent form of a column and whether it differs from the stored text.

    Null texts give null and false; empty texts stay empty; repeated rows, extra
    columns and any length of text pass through; an empty table stays empty.
    """
    out = df.withColumn(into, canonical_text(F.col(text)))
    return out.withColumn(changed, F.coalesce(F.col(into) != F.col(text), F.lit(False)))


def found(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """Records whose text or title was not in its consistent form, one row each."""
    parts = []
    for kind, df, key, text in (("block", blocks, "block_id", "text"), ("section", sections, "section_id", "title")):
        own = df.where(F.col(key).isNotNull() & suspect(F.col(text)))
        parts.append(
            consistent(own.select(F.col(key).alias("record_id"), F.col(text).alias("text")), "text")
            .where("is_changed")
            .select(F.lit(kind).alias("record_kind"), "record_id")
        )
    return parts[0].unionByName(parts[1]).distinct()
