import random
import re

import numpy as np

from babelframe.llm import codes as C
from babelframe.llm.leaks import leak_report, leaked_items

DOC, ITEM = "doc_id bigint, text string, item_id string, n int", "item_id bigint, split_name string, lang string, text_kind string, text string, doc_id string"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], DOC)


def items(spark, *texts):
    return spark.createDataFrame([(100 + i, "test", "eng", "q", t, "y") for i, t in enumerate(texts)], ITEM)


def brute(texts, tests):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = set()
    for i, t in enumerate(texts):
        w = words(t)
        for j, x in enumerate(tests):
            v = words(x)
            n = min(12, len(v))
            runs = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            if any(tuple(w[k : k + n]) in runs for k in range(len(w) - n + 1)):
                found.add((i, 100 + j))
    return sorted(found)


def test_random_texts_against_brute_force(spark, rows_of):
    rng = random.Random(11)
    vocabulary = ["a", "b", "Ça", "да", "été"]
    say = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "_", "\n", "—"]) for _ in range(n))
    texts = [say(rng.randint(0, 120)) for _ in range(150)]
    tests = [say(rng.randint(0, 30)) for _ in range(60)] + [texts[3][:40], "", None]
    wanted = brute(texts, tests)
    for bits, hot in ((1 << 20, 50_000), (64, 20)):  # a sieve that passes little, and a full one with hot signatures
        assert rows_of(leaked_items(docs(spark, *texts), items(spark, *tests), sieve_bits=bits, hot_rows=hot)) == wanted
    assert len(wanted) > 100


def test_edges(spark, rows_of):
    one = " ".join(f"w{i}" for i in range(12))
    texts = [None, "", "  ", "x " + one.upper() + "!", one[:-3], "w1", "w1" * 500_000]
    tests = [one, "W1", None, "...", "w1"]
    found = leaked_items(docs(spark, *texts), items(spark, *tests))
    assert rows_of(found) == [(3, 100), (3, 101), (3, 104), (4, 101), (4, 104), (5, 101), (5, 104)]
    report = rows_of(leak_report(found, items(spark, *tests)), "item_id", "n_documents")
    assert report == [(100, 1), (101, 3), (102, 0), (103, 0), (104, 3)]
    assert leaked_items(docs(spark).limit(0), items(spark, one)).count() == 0
    assert leaked_items(docs(spark, one), items(spark)).count() == 0


def test_words_of_neighbouring_texts_stay_apart(spark, rows_of):
    assert rows_of(leaked_items(docs(spark, "one two", "three four"), items(spark, "two three", "twothree", "three four"))) == [(1, 102)]


def test_sieve_passes_its_own_keys_and_few_others(spark):
    keys = spark.range(0, 40_000, 2)
    made = C.sieve(keys)
    assert len(made.holds(np.arange(0, 40_000, 2, dtype=np.uint64))) == 20_000
    assert len(made.holds(np.arange(1, 40_000, 2, dtype=np.uint64))) < 200
    assert len(C.sieve(keys.limit(0)).holds(np.arange(100, dtype=np.uint64))) == 0


def test_runs_of_one_signature_in_one_text(spark, rows_of):
    # neighbouring runs often share their least shingles
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    tests = [" ".join(t.split()[k : k + n]) for t in texts for k, n in ((10, 7), (11, 9), (12, 10), (20, 12), (21, 30))]
    assert rows_of(leaked_items(docs(spark, *texts), items(spark, *tests))) == brute(texts, tests)
