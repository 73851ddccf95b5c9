"""Column functions on text: normal forms, tokens, sentences, numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The ranking tokens are compounds, words, signed numbers, CJK characters.
RANK_TOKEN = r"[a-z]+(?:-[a-z0-9]+)+|[a-z][a-z0-9_]*|[-+]?[0-9]+(?:\.[0-9]+)?(?:e[-+]?[0-9]+)?%?|[㐀-鿿]"
CJK = "[㐀-鿿]"
PLAIN_TOKEN = r"[\p{L}\p{N}_]+"


def collapse(text: Column) -> Column:
    """Soft hyphens dropped, white space runs to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "­", ""), r"[\s  -  　]+", " "))


def match_form(text: Column) -> Column:
    """Case-folded words separated by single blanks."""
    return F.trim(F.regexp_replace(casefold(text), r"[^\p{L}\p{N}_]+", " "))


def casefold(text: Column) -> Column:
    """Lower case with the folding of sharp s."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def rank_tokens(text: Column) -> Column:
    """Ranking tokens; runs of CJK characters also give their bigrams. Null text gives null."""
    raw = F.regexp_extract_all(casefold(text), F.lit(f"({RANK_TOKEN})"), 1)

    def with_pairs(said: Column) -> Column:
        both = lambda i: F.get(said, i).rlike(f"^{CJK}$") & F.get(said, i + 1).rlike(f"^{CJK}$")
        pairs = F.transform(F.filter(F.sequence(F.lit(0), F.size(said) - 2), both), lambda i: F.concat(F.get(said, i), F.get(said, i + 1)))
        return F.when(F.size(said) < 2, said).otherwise(F.concat(said, pairs))

    # Bound once by the outer transform, else every step would search the text again; most texts hold no CJK.
    return F.when(text.rlike(CJK), F.get(F.transform(F.array(raw), with_pairs), F.lit(0))).otherwise(raw)


def plain_tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and ``_``."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({PLAIN_TOKEN})"), 1)


def token_estimate(text: Column) -> Column:
    """Runs of ASCII word characters, CJK characters and a third of the marks, at least one."""
    runs = F.regexp_count(text, F.lit("[A-Za-z0-9_]+"))
    marks = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}_\s]"))
    return F.greatest(F.lit(1), runs + F.regexp_count(text, F.lit(CJK)) + F.floor(marks / 3).cast("int"))


def dehyphenate(text: Column) -> Column:
    """Join a word cut by a hyphen and white space before a lower-case letter."""
    return F.regexp_replace(text, r"([A-Za-z])-\s+([a-z])", "$1$2")


def sentences(text: Column) -> Column:
    """Split after a closing mark that white space and a capital, quote or CJK character follow."""
    return F.split(text, r"(?<=[.!?。！？])\s+(?=[A-Z\"'“‘一-鿿])")


#: Steps that bring a written number to its value: leading zeros, a bare point, zeros behind the point, minus zero.
NUMBER_FORMS = [
    (r"^(-?)0+([0-9])", r"\1\2"), (r"^(-?)\.", r"\1" + "0."), (r"(\.[0-9]*[1-9])0+(%?)$", r"\1\2"), (r"\.0*(%?)$", r"\1"), (r"^-0(%?)$", r"0\1"),
]
NUMBER = r"(?:^|[^\p{L}\p{N}_])([-−–]?[+]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][-−–]?[0-9]+)?(?:[ ]*%)?)"


def number_value(said: Column) -> Column:
    """A number as its value: no plus sign, no zeros that do not count; a percentage keeps its sign, so 0.50 is 0.5 and not 50%."""
    x = F.translate(said, "−– +", "--")
    power = F.concat(F.regexp_replace(x, "%", "").try_cast("double").cast("decimal(38,12)").cast("string"), F.when(x.contains("%"), "%").otherwise(""))
    x = F.when(x.rlike("[eE]"), F.coalesce(power, x)).otherwise(x)
    for pattern, into in NUMBER_FORMS:
        x = F.regexp_replace(x, pattern, into.replace("\\", "$"))
    return x


def numbers(text: Column) -> Column:
    """The sorted distinct numbers of a text by value (:func:`number_value`)."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), 1)
    return F.array_sort(F.array_distinct(F.transform(found, number_value)))


def jaccard(a: Column, b: Column) -> Column:
    """Token Jaccard of two arrays; two empty arrays are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def short_hash(*parts: Column, length: int = 24) -> Column:
    """Leading hex digits of the SHA-256 of the parts joined by ``|``."""
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(length))


def contains_any(text: Column, markers: list[str]) -> Column:
    """Whether the text holds any of the markers literally."""
    out = F.lit(False)
    for m in markers:
        out = out | text.contains(m)
    return out
