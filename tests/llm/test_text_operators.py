import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import languages, leaks, neardup, pieces

WORDS = [f"w{i}" for i in range(400)]


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def corpus(seed=3):
    rng = random.Random(seed)
    base = [[rng.choice(WORDS) for _ in range(rng.randint(24, 80))] for _ in range(40)]
    out = []
    for i, words in enumerate(base):
        out.append((f"o{i:03d}", " ".join(words)))
        for k in range(rng.randint(0, 3)):
            w = list(words)
            for _ in range(rng.randint(0, 9)):
                at = rng.randrange(len(w))
                action = rng.random()
                if action < 0.4:
                    w[at] = rng.choice(WORDS)
                elif action < 0.7 and len(w) > 25:
                    del w[at]
                else:
                    w.insert(at, rng.choice(WORDS))
            out.append((f"c{i:03d}{k}", " ".join(w).capitalize() + "."))
    return out


@pytest.mark.parametrize("crowd", [20_000, 2])
def test_neardup_equals_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(neardup, "CROWD", crowd)  # two rows make a block: the salted path
    data = corpus()
    sets = {i: grams(t.rstrip(".")) for i, t in data if len(t.split()) >= 24}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 3 >= len(sets[a] | sets[b])}
    rows = [(i, "TEXT", t) for i, t in data] + [("c0000", "TEXT", data[1][1])] * 2 + [("x", "TEXT", None), ("y", "TEXT", ""), ("z", "HEADING", data[0][1]), (None, "TEXT", data[0][1])]
    ids = {r[0] for r in rows}
    df = spark.createDataFrame([r for r in rows if r[0] != "c0000" or "c0000" in sets], "block_id string, block_type string, text string").withColumn("row", F.lit("clash"))
    got = {tuple(r) for r in neardup.found(df).collect()}
    assert got == want and ids
    assert neardup.found(df.limit(0)).count() == 0


def test_copies_are_one_class(spark):
    text = " ".join(WORDS[:40])
    df = spark.createDataFrame([(f"k{i}", "TEXT", text) for i in range(30)] + [("o", "TEXT", " ".join(WORDS[5:45]))], "block_id string, block_type string, text string")
    got = {r["block_id"]: (r["copies"], r["links"]) for r in neardup.classes(df).collect()}
    assert got["k0"] == (30, 1) and got["o"] == (1, 1) and len(got) == 31


def test_trie_prunes_nothing_right():
    """Every pair over the threshold meets at its first shared sequence, whatever is cut on the way; no pair meets twice on one path."""
    rng = random.Random(5)
    sets = [sorted(rng.sample(range(60), rng.randint(5, 30))) for _ in range(80)] + [sorted(range(10, 30))] * 2
    length, items = np.array([len(s) for s in sets]), np.concatenate([np.array(s) for s in sets])
    tree = neardup.Trie(length, items, length, np.concatenate([np.arange(n) for n in length]))
    met = {tuple(sorted((int(tree.entry[i]), int(tree.entry[j])))) for x, y in tree.meetings(1, 3) for i, j in zip(x, y)}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if len(set(sets[i]) & set(sets[j])) * 3 >= len(set(sets[i]) | set(sets[j]))}
    assert want <= met < {(i, j) for j in range(len(sets)) for i in range(j)}


def test_counts_and_steps():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 32, 500, dtype=np.uint32))
    assert (neardup._from_steps(neardup._steps(x)) == x).all()
    code = neardup._code(np.array([1, 2, 128, 129, 10**5, 10**9]))
    assert code[0] == 0 and list(code) == sorted(code) and len(set(code[:3])) == 3


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice(WORDS[:60]) for _ in range(rng.choice([6, 10, 25, 40])))) for i in range(25)]
    docs = []
    for d in range(60):
        w = [rng.choice(WORDS[:60]) for _ in range(rng.randint(0, 60))]
        for i, t in rng.sample(items, 2):
            t = t.split()
            n = rng.choice([5, 9, 10, 11, 30])
            s = rng.randrange(max(1, len(t) - n + 1))
            at = rng.randrange(len(w) + 1)
            w[at:at] = t[s : s + n]
        docs.append((d, ", ".join(w).upper().replace(" W1", "\n\nW1")))
    docs += [(90, None), (91, ""), (None, items[0][1]), (0, docs[0][1])]
    windows = {i: {" " + " ".join(t.split()[k : k + 10]) + " " for k in range(len(t.split()) - 9)} for i, t in items}
    plain = lambda t: " " + " ".join(t.lower().replace(",", " ").split()) + " "
    want = {(d, i) for d, t in docs if t and d is not None for i, ws in windows.items() if any(w in plain(t) for w in ws)}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    it = spark.createDataFrame(items + [(99, None), (98, "")], "item_id long, text string")
    assert {tuple(r) for r in leaks.found(df, it).collect()} == want and want
    assert leaks.found(df.limit(0), it).count() == 0 and leaks.found(df, it.limit(0)).count() == 0


def test_leaks_in_several_tables(spark, monkeypatch):
    monkeypatch.setattr(leaks, "TABLE_CHARS", 100)
    items = [(i, " ".join(f"x{i}y{k}" for k in range(12))) for i in range(9)]
    df = spark.createDataFrame([(1, items[3][1] + " and " + items[7][1])], "doc_id long, text string")
    assert {tuple(r) for r in leaks.found(df, spark.createDataFrame(items, "item_id long, text string")).collect()} == {(1, 3), (1, 7)}


C = "chunk_id string, text string, page_start int, token_estimate int, segments array<struct<chunk_char_start:int,chunk_char_end:int,block_id:string,block_char_start:int,block_char_end:int,page:int>>"


def test_pieces(spark):
    rng = random.Random(2)
    sentence = lambda topic: " ".join(rng.choice(WORDS[topic * 40 : topic * 40 + 40]) for _ in range(rng.randint(6, 18))).capitalize() + ". "
    text = "\n\n".join("".join(sentence(t) for _ in range(30)) for t in range(4))
    solid = "word " * 3000
    cjk = "样本在没有额外标注时比较了协议。" * 120
    data = [("a", text, None, 3, [(0, 900, "b", 0, 900, 4), (900, 90_000, "c", 0, 9, 5)]), ("b", solid, 7, None, None), ("c", "short text.", 1, 9999, None), ("d", None, 1, 1, None), ("e", "", 1, 1, None), ("f", cjk, 2, None, []), (None, solid, 1, 1, None), ("g", "x" * 200_000, 1, 1, None)]
    df = spark.createDataFrame(data, C).withColumn("piece", F.lit("clash"))
    assert {r[0] for r in pieces.found(df).collect()} == {"a", "b", "f"}
    got = pieces.pieces(df.where("chunk_id is not null")).collect()
    by = {}
    for r in got:
        by.setdefault(r["chunk_id"], []).append(r)
    texts = {d[0]: d[1] for d in data}
    for chunk, rows in by.items():
        rows.sort(key=lambda r: r["piece"])
        assert rows[0]["char_start"] == 0 and rows[-1]["char_end"] == len(texts[chunk])
        for a, b in zip(rows, rows[1:]):
            assert a["char_start"] < b["char_start"] <= a["char_end"]
            assert 40 <= b["overlap"] <= 60
        assert all(r["tokens"] <= 650 and r["text"] == texts[chunk][r["char_start"] : r["char_end"]] for r in rows)
    assert all(r["text"].rstrip().endswith(".") for r in by["a"])
    assert by["a"][0]["page_start"] == 4 and by["a"][-1]["page_start"] == 5 and by["b"][0]["page_start"] == 7
    assert pieces.found(df.limit(0)).count() == 0
    assert {r["chunk_id"] for r in pieces.within(df).collect()} >= {"a", "b", "c", "f", "g"}


SAMPLES = {
    "en": "The method of the paper improves the result. We show that this is not the case for all of the pages. There are many more words in the text.",
    "de": "Das Verfahren der Arbeit verbessert das Ergebnis. Wir zeigen, dass dies nicht für alle Seiten gilt. Es gibt noch viele weitere Wörter im Text.",
    "fr": "La méthode de cet article améliore le résultat. Nous montrons que ce n'est pas le cas pour toutes les pages. Il y a encore beaucoup de mots dans le texte.",
    "es": "El método de este artículo mejora el resultado. Mostramos que no es así para todas las páginas. Hay muchas más palabras en el texto.",
    "pt": "O método deste artigo melhora o resultado. Mostramos que não é assim para todas as páginas. Há muito mais palavras no texto.",
    "ru": "Метод этой статьи улучшает результат. Мы показываем, что это не так для всех страниц. В тексте есть ещё много слов.",
    "zh": "本文的方法改进了结果。我们表明并非所有页面都是如此。文本中还有很多词语。",
}


def language_docs():
    data = [(i * 10 + k, t, {0: c, 1: c.upper(), 2: f"{c}-XX"}.get(k, c)) for i, (c, t) in enumerate(SAMPLES.items()) for k in range(6)]
    data += [
        (900, SAMPLES["de"], "en"), (901, SAMPLES["fr"], None), (902, SAMPLES["en"] + "\n" + SAMPLES["ru"], "en"), (903, None, "en"), (904, "", None),
        (905, "123 456", "und"), (906, SAMPLES["en"] * 2000, "English"), (900, SAMPLES["de"], "en"),
    ]
    return data


@pytest.fixture(scope="module")
def model(spark):
    return languages.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_languages(spark, model):
    df = spark.createDataFrame(language_docs(), "doc_id long, text string, lang string").withColumn("label", F.lit("clash"))
    got = {tuple(r) for r in languages.found(df, model).collect()}
    assert got == {(900, "de"), (901, "fr"), (902, "en"), (902, "ru")}
    segs = languages.segments(df, model).where("doc_id = 902").orderBy("char_start").collect()
    assert [s["lang"] for s in segs] == ["en", "ru"] and all(s["confidence"] > 0.8 for s in segs)
    assert languages.found(df.limit(0)).count() == 0 and languages.found(df).count() > 0


def test_codewords_are_apart():
    code = languages.codewords()
    assert min((code[i] != code[j]).sum() for i in range(7) for j in range(i)) >= 6


def test_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = languages.fit(documents.where("doc_id % 2 = 0"))
    held = languages.labels(documents.where("doc_id % 2 = 1"), model).where("not is_missing and not is_mixed")
    right = held.select(F.avg((F.col("lang") == languages.normal_label(F.col("label"))).cast("double"))).first()[0]
    assert right > 0.9  # some labels are wrong on purpose


def test_neardup_mends_misread_words(spark):
    """Two copies that differ by misread words alone share too few sequences unless these are corrected first."""
    words = [a + b for a in ("mar", "ter", "lum", "sor", "ken", "pol") for b in ("ginal", "nesto", "marik", "lindo", "kernos")]
    clean = " ".join(words)
    noisy = " ".join(w.replace("m", "rn", 1) if "m" in w and i % 2 == 0 else w.replace("l", "1", 1) if "l" in w else w for i, w in enumerate(words))
    rows = [("a", "TEXT", clean), ("b", "TEXT", noisy)] + [(f"w{i}-{j}", "TEXT", f"{w} alone") for i, w in enumerate(words) for j in range(40)]
    df = spark.createDataFrame(rows, "block_id string, block_type string, text string")
    assert [tuple(r) for r in neardup.found(df).collect()] == [("a", "b")]
