"""Problem 5: spellings of one person or organisation.

Every name is rewritten to all its canonical forms: surname with the initial of
the given name and of each short name, legal forms and disciplines of an
organisation cut to initials, both token orders (weighed by how the tokens are
used elsewhere), umlauts and accents folded, and each one-letter omission of the
surname or place, so that two spellings one slip apart share a form. The forms
are exploded and equi-joined; a shared form counts the more the fewer names it
has. Links through omissions are confirmed by the edit distance and by agreeing
given names, at any count; where only initials meet, by the ratio of the two
spellings' counts or by how often the corpus's full given names agree across a slip.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quire.session import durable, pairs_within

# Given names with their short forms.
NICKNAMES = {
    "alexander": ["alex", "sasha", "xander", "sandy"], "andrew": ["andy", "drew"], "anthony": ["tony"],
    "barbara": ["barb", "babs"], "benjamin": ["ben", "benny"], "catherine": ["cathy", "kate", "katie", "cath"],
    "charles": ["charlie", "chuck"], "charlotte": ["lottie", "charlie", "lotte"], "christina": ["tina", "chris"],
    "christopher": ["chris", "kit", "topher"], "daniel": ["dan", "danny"], "david": ["dave"],
    "deborah": ["deb", "debbie"], "dorothea": ["dot", "dora", "thea", "dolly"], "dorothy": ["dot", "dottie", "dolly"],
    "edward": ["ed", "eddie", "ted", "ned", "teddy"], "elizabeth": ["liz", "beth", "betty", "eliza", "lizzie", "betsy", "lisa"],
    "florence": ["flo"], "francis": ["frank"], "francois": ["frank"], "frederick": ["fred", "freddie", "rick"],
    "gabriella": ["gabi", "gabby", "ella"], "gerald": ["gerry", "jerry"], "gregory": ["greg"], "harold": ["harry", "hal"],
    "helen": ["nell", "nellie"], "henrietta": ["etta", "hetty", "harriet"], "henry": ["harry", "hank", "hal"],
    "ingrid": ["inga", "inge"], "isabella": ["bella", "izzy", "belle", "isa"], "jacob": ["jake"],
    "jacqueline": ["jackie", "jacqui"], "james": ["jim", "jimmy", "jamie"], "jennifer": ["jen", "jenny"],
    "john": ["jack", "johnny"], "jonathan": ["jon", "jonny"], "joseph": ["joe", "joey"],
    "josephine": ["jo", "josie", "josy", "fifi"], "joshua": ["josh"], "katherine": ["kate", "kathy", "katie", "kat", "kitty"],
    "lawrence": ["larry"], "leonard": ["leo", "len", "lenny"], "louise": ["lou"], "margaret": ["peggy", "maggie", "meg", "greta", "madge", "daisy"],
    "martha": ["patty"], "mary": ["molly", "polly"], "matthew": ["matt"], "matthias": ["matt", "matti"],
    "michael": ["mike", "mick", "mickey"], "nathaniel": ["nat", "nate"], "nicholas": ["nick", "nicky"],
    "oliver": ["ollie", "olly"], "patricia": ["pat", "patty", "tricia"], "patrick": ["pat", "paddy"],
    "penelope": ["penny", "pen"], "peter": ["pete"], "philip": ["phil"], "quentin": ["quint"], "rebecca": ["becky"],
    "renee": ["ren"], "richard": ["dick", "rick", "rich"], "robert": ["bob", "rob", "bobby", "bert"], "ronald": ["ron"],
    "samuel": ["sam", "sammy"], "sarah": ["sally", "sadie"], "stephen": ["steve"], "susan": ["sue", "susie"],
    "susanna": ["sue", "susie", "sanna", "anna"], "theodora": ["thea", "dora", "theo"], "theodore": ["ted", "theo", "teddy"],
    "thomas": ["tom", "tommy"], "timothy": ["tim"], "ursula": ["ursel", "uschi", "ulla"], "victoria": ["vicky", "tori", "vic"],
    "walter": ["walt", "wally"], "wilhelm": ["willi", "will"], "william": ["bill", "will", "billy", "liam", "willy"],
    "yvonne": ["eve", "vonnie"], "zacharias": ["zack", "zach", "zac"], "zoe": ["zo"],
}
# Words that make a name an organisation's, with their abbreviations.
ORGANISATION = [
    "academy", "acad", "association", "assoc", "center", "centre", "ctr", "college", "coll", "company", "consortium", "cons", "consort",
    "corporation", "corp", "council", "department", "dept", "faculty", "foundation", "fdn", "found", "gmbh", "group", "inc", "institute",
    "inst", "institut", "lab", "laboratory", "laboratories", "labs", "llc", "ltd", "ministry", "observatory", "research", "res", "school",
    "sch", "society", "soc", "team", "university", "univ", "collaboration", "collab",
]
LEGAL = ["inc", "ltd", "llc", "gmbh", "corp", "co", "plc", "ag", "sa", "the", "of", "for", "and", "de", "du", "der", "fur", "on", "in"]
TITLES = ["dr", "prof", "professor", "mr", "mrs", "ms", "sir", "dame", "phd", "md", "jr", "sr", "ii", "iii"]
NO_NAMES = ["et al", "et al.", "others", "and others", "n/a", "anonymous", "unknown", ""]
#: Where only initials meet, a slip's spelling has this many times fewer names, ...
SLIP_RATIO = 2
#: ... or at least this share of the slip pairs with two full given names agrees in them.
SLIP_AGREES = 0.9
SHORT_OF: dict[str, list[str]] = {}
for _full, _short in NICKNAMES.items():
    for _s in _short:
        SHORT_OF.setdefault(_s, []).append(_full)


def fold(text: str, digraphs: bool = True) -> str:
    """Lower case without accents; with ``digraphs``, ``ae``, ``oe`` and ``ue`` count as ``ä``, ``ö`` and ``ü``."""
    t = text.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("Ł", "L").replace("æ", "ae").replace("Æ", "Ae")
    t = "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch)).lower()
    t = re.sub(r"[^\w\s]", "", t)
    return re.sub("([aou])e", r"\1", t) if digraphs else t


def clean(name: str) -> str:
    """The name without invisible characters, footnote marks, titles and doubled blanks."""
    t = unicodedata.normalize("NFKC", name)
    t = "".join(" " if unicodedata.category(ch) == "Zs" else ch for ch in t if unicodedata.category(ch) != "Cf")
    t = re.sub(r"[\d*†‡§¶#]+\s*$", "", t.strip())
    t = re.sub(r"^(?:(?:Dr|Prof|Mr|Mrs|Ms|Sir)\b\.?\s+)+", "", t, flags=re.I)
    t = re.sub(r",?\s+(?:Jr|Sr|PhD|MD|II|III)\b\.?$", "", t, flags=re.I)
    return re.sub(r"\s+", " ", t).strip(" ,;")


def is_initials(token: str) -> bool:
    letters = re.sub(r"[^\w]", "", token)
    return 0 < len(letters) <= 3 and (len(letters) == 1 or letters.isupper()) and not letters.isdigit()


def parse(name: str) -> tuple[str, list[tuple[str, str, bool]]]:
    """(kind, readings): ``person`` with (given, surname, is_sure) or ``organisation`` with (rest, place, True)."""
    if name is None or name.strip().lower() in NO_NAMES:
        return "none", []
    t = clean(name)
    if not t:
        return "none", []
    bare = re.sub(r"\s*\([^)]*\)\s*", " ", t).strip()
    words = [fold(w) for w in re.split(r"[\s,]+", bare) if fold(w)]
    raw = bare.replace(",", " ").split()
    acronym = len(raw) == 2 and len(raw[1]) >= 3 and raw[1].isupper() and raw[1].isalpha() and not raw[0].isupper() and "," not in bare
    if acronym or (len(words) > 1 and any(w in ORGANISATION for w in words) and (len(words) > 2 or any(w in ORGANISATION for w in words[1:]))):
        parts = [p.strip() for p in bare.split(",") if p.strip()]
        if len(parts) == 2 and len(parts[1].split()) == 1:
            place, rest = fold(parts[1]), parts[0].split()
        else:
            all_ = [w for w in raw if fold(w) and fold(w) not in LEGAL]
            if not all_:
                return "none", []
            place, rest = fold(all_[0]), all_[1:]
        if acronym:
            short = raw[1].lower()
        else:
            short = "".join(fold(w)[0] for w in rest if fold(w) and fold(w) not in LEGAL)
        return ("organisation", [(short, place, True)]) if place and short else ("none", [])
    if "," in t:
        a, _, b = t.partition(",")
        a, b = a.strip(), b.strip()
        if not a or not b:
            t = a or b
        elif all(is_initials(x) for x in a.split()) and not all(is_initials(x) for x in b.split()):
            return "person", [(a, b, True)]
        else:
            return "person", [(b, a, True)]
    tokens = t.split()
    if len(tokens) == 1:
        return "person", [("", tokens[0], True)]
    caps = [w for w in tokens if len(re.sub(r"\W", "", w)) >= 3 and w.isupper()]
    if caps and len(caps) < len(tokens):
        if tokens[0].isupper() and not is_initials(tokens[0]):
            return "person", [(" ".join(tokens[1:]), tokens[0], True)]
        if tokens[-1].isupper() and not is_initials(tokens[-1]):
            return "person", [(" ".join(tokens[:-1]), tokens[-1], True)]
    if is_initials(tokens[0]):
        return "person", [(" ".join(tokens[:-1]), tokens[-1], True)]
    if is_initials(tokens[-1]):
        return "person", [(tokens[-1], " ".join(tokens[:-1]), True)]
    if any(is_initials(x) for x in tokens[1:-1]):
        return "person", [(" ".join(tokens[:-1]), tokens[-1], True)]
    return "person", [(" ".join(tokens[:-1]), tokens[-1], False), (" ".join(tokens[1:]), tokens[0], False)]


def given_of(given: str) -> str:
    """The folded first given name; initials keep their first letter only."""
    first = given.split()[0] if given.split() else ""
    f = _key(first)
    return f[:1] if is_initials(first) else f


def full_names(given: str) -> list[str]:
    """The full names a folded given name may stand for, itself among them."""
    name = _restore(given)
    return sorted({name, *SHORT_OF.get(name, [])}) if len(given) > 1 else []


def short_initials(given: str) -> list[str]:
    """Initials of the short names of a full name, or of the full names of a short one, but its own."""
    name = _restore(given)
    if len(given) < 2:
        return []
    out = {f[0] for f in SHORT_OF.get(name, [])}
    for full in (name, *SHORT_OF.get(name, [])):
        out |= {s[0] for s in NICKNAMES.get(full, [])}
    return sorted(out - {given[0]})


#: The fold drops the e of ae, oe, ue; nickname tables are looked up folded as well.
_FOLDED = {fold(n): n for n in [*SHORT_OF, *NICKNAMES]}


def _restore(folded: str) -> str:
    return _FOLDED.get(folded, folded)


def _key(word: str) -> str:
    return re.sub(r"\s+", "", fold(word))


def one_slip(a: str, b: str) -> bool:
    """Whether the words differ by at most one insertion, omission, substitution or swap of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return long[i + 1 :] == short[i:]


def _readings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for name in pdf["name"]:
            kind, found_ = parse(name)
            for order, (given, surname, sure) in enumerate(found_):
                if kind == "organisation":
                    rows.append((name, "o", given, surname, given, [], [], order, True))
                elif _key(surname):
                    g = given_of(given)
                    for key in sorted({_key(surname), re.sub(r"\s+", "", fold(surname, False))}):
                        rows.append((name, "p", g, key, g[:1], full_names(g), short_initials(g), order, sure))
        yield pd.DataFrame(rows, columns=["name", "kind", "given", "surname", "initial", "full", "short", "turned", "sure"])


READING = (
    "name string, kind string, given string, surname string, initial string, full array<string>, short array<string>, turned int, sure boolean"
)


def readings(names: DataFrame) -> DataFrame:
    """One reading of each name.

    Where the order of given name and surname is open, the tokens' use in all
    other names decides: names whose form fixes the order count fully, the usual
    order (surname last) of the others by half.
    """
    every = durable(names.mapInPandas(_readings, READING))
    people = every.where("kind = 'p' and turned = 0")
    weight = F.when(F.col("sure"), 2.0).otherwise(0.5)
    use = (
        people.where("length(given) > 1").select(F.col("given").alias("token"), weight.alias("g"), F.lit(0.0).alias("s"))
        .union(people.select("surname", F.lit(0.0), weight))
        .groupBy("token").agg(F.sum("g").alias("g"), F.sum("s").alias("s"))
    )
    listed = F.when(F.col("token").isin(sorted({*NICKNAMES, *SHORT_OF})), 4.0).otherwise(0.0)
    use = durable(use.withColumn("leaning", F.log((F.col("g") + listed + 0.5) / (F.col("s") + 0.5))).select("token", "leaning"))
    open_ = people.where("not sure").select("name", "given", "surname")
    turned = (
        open_.join(use.select(F.col("token").alias("given"), F.col("leaning").alias("a")), "given", "left")
        .join(use.select(F.col("token").alias("surname"), F.col("leaning").alias("b")), "surname", "left")
        .where(F.coalesce("a", F.lit(0.0)) < F.coalesce("b", F.lit(0.0)))
        .select("name", F.lit(1).alias("turn"))
    )
    out = every.join(turned, "name", "left")
    return out.where(F.col("sure") | (F.col("turned") == F.coalesce("turn", F.lit(0)))).drop("turned", "turn", "sure")


def _omissions(word: Column) -> Column:
    """The word and, from three letters on, each of its one-letter omissions."""
    each = F.transform(
        F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))
    )
    return F.when(F.length(word) < 3, F.array(word)).otherwise(F.array_distinct(F.array_append(each, word)))


def _agreement(kind: str, a: str, b: str) -> bool | None:
    """Whether two given names (of an organisation: two short forms) agree; None where they cannot tell."""
    if kind == "o":
        return True if a == b else None
    if len(a) < 2 or len(b) < 2:
        return None
    return one_slip(a, b) or bool(set(full_names(a)) & set(full_names(b)))


def _slips(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        near = pdf[[a != b and one_slip(a, b) for a, b in zip(pdf["surname_a"], pdf["surname_b"])]]
        agrees = [_agreement(*x) for x in zip(near["kind"], near["given_a"], near["given_b"])]
        long = [min(len(a), len(b)) >= 4 for a, b in zip(near["surname_a"], near["surname_b"])]
        yield near[["kind", "name_a", "name_b", "rarer", "commoner"]].assign(agrees=pd.array(agrees, "boolean"), long=long)


def rewritings(names: DataFrame) -> DataFrame:
    """(name, form): each distinct name with the canonical forms that link it.

    ``et al.``, empty and null names have no form. Names are distinct already or
    made so; the equi-joins carry names, never records, so a name used in a third
    of all records costs no more than any other.
    """
    distinct = names.where("name is not null").select("name").distinct()
    one = durable(readings(distinct))
    form = lambda *parts: F.concat_ws("|", *[F.lit(p) if len(p) == 1 else F.col(p) for p in parts]).alias("form")
    named = one.where("length(given) > 1")
    forms = one.select("name", form("i", "kind", "surname", "initial"))
    forms = forms.union(named.where("kind = 'p'").select("name", "surname", F.explode("full").alias("as")).select("name", form("f", "surname", "as")))
    # A bare initial that no full name of the surname starts with may be that of a short name.
    bare = one.where("kind = 'p' and length(given) = 1").join(named.select("kind", "surname", "initial").distinct(), ["kind", "surname", "initial"], "left_anti")
    shorts = named.where("kind = 'p'").select("name", "surname", F.explode("short").alias("initial"))
    shorts = shorts.join(bare.select("surname", "initial").distinct(), ["surname", "initial"], "left_semi")
    forms = forms.union(bare.select("name", form("n", "surname", "initial"))).union(shorts.select("name", form("n", "surname", "initial"))).distinct()
    # One slip in the surname or place: names that share an omission form and an initial.
    keys = one.groupBy("kind", "surname", "initial").agg(
        F.min("name").alias("name"), F.max_by("given", F.length("given")).alias("given"), F.count("*").alias("names")
    )
    keys = durable(keys)
    slips = keys.withColumn("omitted", F.explode(_omissions(F.col("surname"))))
    a, b = slips.alias("a"), slips.alias("b")
    near = a.join(
        b,
        (F.col("a.omitted") == F.col("b.omitted")) & (F.col("a.initial") == F.col("b.initial")) & (F.col("a.kind") == F.col("b.kind"))
        & (F.col("a.surname") < F.col("b.surname")),
    )
    near = near.select(
        F.col("a.kind").alias("kind"), F.col("a.surname").alias("surname_a"), F.col("b.surname").alias("surname_b"),
        F.col("a.given").alias("given_a"), F.col("b.given").alias("given_b"), F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"),
        F.least("a.names", "b.names").alias("rarer"), F.greatest("a.names", "b.names").alias("commoner"),
    ).distinct()
    near = durable(near.mapInPandas(_slips, "kind string, name_a string, name_b string, rarer long, commoner long, agrees boolean, long boolean"))
    # Full given names on both sides decide; initials alone follow the counts, or what the full names of this corpus show.
    told = near.where("kind = 'p'").agg(F.count_if("agrees").alias("right"), F.count("agrees").alias("all")).first()
    trusted = (told["right"] + 1) / (told["all"] + 2) >= SLIP_AGREES
    lopsided = (F.col("rarer") == 1) | (F.col("rarer") * SLIP_RATIO <= F.col("commoner"))
    # A slip in a surname of under five letters is as often another surname: both given names have to say so.
    unsure = F.col("agrees").isNull() & F.col("long") & (lopsided | (F.col("kind") == "p") & F.lit(trusted))
    slipped = near.where(F.col("agrees") | unsure).select("name_a", "name_b")
    joined = forms.unionByName(
        slipped.select(F.concat_ws("|", F.lit("slip"), "name_a", "name_b").alias("form"), F.explode(F.array("name_a", "name_b")).alias("name")).select("name", "form")
    )
    return durable(joined.distinct())


def entities(names: DataFrame) -> DataFrame:
    """(name, entity): each distinct name with its entity, the least of its spellings."""
    return components(rewritings(names))


def components(edges: DataFrame) -> DataFrame:
    """(name, entity): connected names through shared forms, by least-name propagation until nothing changes.

    A label is itself a name, so each round also takes the label of the label,
    which keeps the rounds of long chains few.
    """
    labels = durable(edges.groupBy("form").agg(F.min("name").alias("low")).join(edges, "form").groupBy("name").agg(F.min("low").alias("entity")))
    while True:
        low = edges.join(labels, "name").groupBy("form").agg(F.min("entity").alias("low"))
        nxt = durable(edges.join(low, "form").groupBy("name").agg(F.min("low").alias("entity")))
        further = nxt.select(F.col("name").alias("entity"), F.col("entity").alias("further"))
        nxt = durable(nxt.join(further, "entity").select("name", F.col("further").alias("entity")))
        changed = nxt.join(labels.withColumnRenamed("entity", "was"), "name").where("entity < was").limit(1).count()
        labels = nxt
        if not changed:
            return labels


def names_in(*tables: DataFrame) -> DataFrame:
    """The distinct author strings of the tables' ``authors`` arrays; null and empty arrays give none."""
    out = None
    for df in tables:
        one = df.select(F.explode("authors").alias("name")).where("name is not null").distinct()
        out = one if out is None else out.union(one)
    return out.distinct()


def linked(*tables: DataFrame) -> DataFrame:
    """(name, entity, spellings, rarity): every spelling with its entity, how many it has and how telling its form is.

    ``rarity`` is one over the number of names that share the rarest form by which
    the name is linked to another; 1 where nothing links it.
    """
    forms = rewritings(names_in(*tables))
    labels = durable(components(forms))
    size = labels.groupBy("entity").agg(F.count("*").alias("spellings"))
    held = forms.groupBy("form").agg(F.count("*").alias("n")).where("n > 1")
    rare = forms.join(held, "form").groupBy("name").agg(F.min("n").alias("n"))
    out = labels.join(size, "entity").join(rare, "name", "left")
    return out.select("name", "entity", "spellings", F.round(1 / F.coalesce("n", F.lit(1)), 6).alias("rarity"))


def found(*tables: DataFrame) -> DataFrame:
    """(name_a, name_b): two different spellings of one entity, the smaller first by code point."""
    labels = durable(entities(names_in(*tables)))
    return pairs_within(labels, "entity", "name").select(F.col("x").alias("name_a"), F.col("y").alias("name_b"))
