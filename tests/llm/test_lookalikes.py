import random
import unicodedata

from babelframe.llm import glyphs as G
from babelframe.llm import lookalikes as L

KIND = "field_name string, key string, text string, done string"


def frame(spark, *rows):
    return spark.createDataFrame([("documents", k, t, "x") for k, t in rows], KIND)


def pairs(spark, *rows):
    return sorted((r["key_a"], r["key_b"]) for r in L.same_looking(frame(spark, *rows)).collect())


def test_folding():
    assert G.fold("ｃａｆｅ́ ﬁn­al​﻿ ２") == "café final 2"
    assert G.fold("re‑do") == "re-do"
    assert G.fold("⽅了海") == "方了海"
    for keep in ("x²", "½", "™", "Straße", "É", "№ 5", "a – b", "naïve"):
        assert G.fold(keep) == unicodedata.normalize("NFC", keep)


def test_persian_shapes():
    assert G.fold("يک") == "یک"  # joined to the next letter: same shape
    assert G.fold("کي") == "کي"  # final: two dots
    assert G.fold("كا") == "کا" and G.fold("اك") == "اك"
    assert G.fold("می‌کند") == "می‌کند"  # parts joined letters
    assert G.fold("دا‌د") == "داد"  # these never join
    assert G.fold("می‌ کند") == "می کند"
    assert G.fold("٣٤") == "۳٤"  # the four differs


def test_repair_needs_the_vocabulary(spark):
    clean, mixed, foreign = "the school opened in town", "thе sсhооl оpеnеd in tоwn", "ТАРН opened"
    got = {r["key"]: r["text"] for r in L.consistent(frame(spark, ("a", clean), ("b", mixed), ("c", foreign), ("d", "zеbrа unknown"))).select("key", "text").collect()}
    assert got["b"] == clean and got["c"] == foreign
    assert got["d"] == "zеbrа unknown"  # no such word in the corpus
    assert G.candidate("Haш", "latin") == "Наш" and G.candidate("xщf", "latin") is None
    assert G.candidate("fа́c", "latin") == "fác"


def test_words_of_lookalikes_follow_the_text(spark):
    got = {r["key"]: r["text"] for r in L.consistent(frame(spark, ("a", "Hо рядом"), ("b", "Но рядом"))).select("key", "text").collect()}
    assert got["a"] == got["b"] == "Но рядом"


def test_pairs(spark):
    base = "A quiet café near Brymoria 12"
    rows = [("d", base), ("d", base), ("b", unicodedata.normalize("NFD", base)), ("c", base), ("a", base.replace("o", "о")), ("e", base.upper()), ("f", base.replace("é", "e")), ("g", base.replace("12", "1²"))]
    assert pairs(spark, *rows) == sorted([("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d")])


def test_null_blank_and_empty(spark):
    assert pairs(spark, ("a", None), ("b", ""), ("c", " "), ("d", " "), ("e", "​\n"), (None, "x"), ("g", "ｘ")) == []
    assert pairs(spark) == []
    long = "word " * 100_000
    assert pairs(spark, ("a", long), ("b", long.replace(" ", " ", 1)), ("a", long + "​")) == [("a", "b")]


def test_brute_force(spark):
    rng = random.Random(3)
    words = ["coast", "paper", "опора", "сосна", "sea", "12"]
    swap = str.maketrans("aocepx", "аосерх")
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(words) for _ in range(2))
        how = i % 4
        rows.append((f"k{i}", text.translate(swap) if how == 1 and text.isascii() else text.replace(" ", " ") if how == 2 else text))
    skeleton = lambda t: t.replace(" ", " ").translate({v: k for k, v in swap.items()})
    wanted = sorted({tuple(sorted((a, b))) for a, s in rows for b, t in rows if a < b and s != t and skeleton(s) == skeleton(t)})
    assert pairs(spark, *rows) == wanted


def test_titles(spark):
    docs = spark.createDataFrame([], "doc_id string, documents string, lang string")
    topics = spark.createDataFrame([("T1", [("eng", "Tоpic", "d"), None, (None, "x", "y")]), ("T2", [("eng", "Topic", None)]), (None, [("eng", "Topic", None)]), ("T3", None)], "topic_id string, topics array<struct<lang:string,topic_title:string,topic_description:string>>")
    got = L.same_looking(L.texts_of(docs, topics)).collect()
    assert [tuple(r) for r in got] == [("topic_title", "T1/eng", "T2/eng")]
