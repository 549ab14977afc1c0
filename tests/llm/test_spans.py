import random

import numpy as np

from babelframe.llm import fmindex as X
from babelframe.llm.spans import shared_amount, shared_spans

KIND = "doc_id bigint, text string, anchor int, seg string, start_at string"


def brute(docs, least):
    holders = {}
    for i, t in docs:
        for j in range(len(t or "") - least + 1):
            holders.setdefault(t[j : j + least], set()).add(i)
    found = {}
    for i, t in docs:
        for j in range(len(t or "") - least + 1):
            if len(holders[t[j : j + least]]) > 1:
                found.setdefault(i, set()).update(range(j, j + least))
    rows = []
    for i, at in found.items():
        for x in sorted(at):
            if rows and rows[-1][0] == i and rows[-1][2] == x:
                rows[-1][2] = x + 1
            else:
                rows.append([i, x, x + 1])
    return sorted(map(tuple, rows))


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, "s", "x") for i, t in docs], KIND)


def made(seed, n=40, letters="abcdefgh é字😀"):
    rng = random.Random(seed)
    say = lambda k: "".join(rng.choice(letters) for _ in range(k))
    pool = [say(rng.randint(30, 160)) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [say(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(pool)
            a = rng.randint(0, 20)
            parts += [p[a : a + rng.randint(20, 160)], say(rng.randint(0, 30))]
        docs.append((i, "".join(parts)))
    return docs


def test_random_texts_against_brute_force(spark, rows_of):
    for seed in range(3):
        docs = made(seed) + [(900, None), (901, ""), (902, "short")]
        docs += [(903, docs[5][1]), (904, docs[5][1])]
        assert rows_of(shared_spans(frame(spark, docs), least=60, shard_chars=2000)) == brute(docs, 60)


def test_crowded_anchors_are_cut_into_shards(spark, rows_of):
    rng = random.Random(1)
    core = "".join(rng.choice("abcdefghij") for _ in range(90))
    docs = [(i, f"{i:05d}" * 12 + core + f"{i * 7:06d}" * 12) for i in range(60)]
    docs += [(100 + i, f"{i:03d}" * 20 + core[20 * (i % 2) : 70] + "x" * i) for i in range(10)]
    for limit in (2, 5, 4000):
        assert rows_of(shared_spans(frame(spark, docs), least=60, shard_segments=limit, hot_rows=10)) == brute(docs, 60)


def test_shards_of_random_texts(spark, rows_of):
    docs = made(7, 60, "ab")
    assert rows_of(shared_spans(frame(spark, docs), least=60, shard_segments=2)) == brute(docs, 60)


def test_repeats_inside_one_document_are_not_shared(spark, rows_of):
    part = "".join(random.Random(4).choice("abcdefghij") for _ in range(100))
    docs = [(1, part + "x" + part), (2, "other" * 30), (2, "other" * 30)]
    assert rows_of(shared_spans(frame(spark, docs), least=60)) == []


def test_one_character_over_and_over(spark, rows_of):
    docs = [(1, "a" * 500), (2, "b" + "a" * 300 + "c"), (3, "a" * 59)]
    assert rows_of(shared_spans(frame(spark, docs), least=60)) == brute(docs, 60)


def test_long_text_and_empty_table(spark, rows_of):
    rng = random.Random(6)
    long = "".join(rng.choices("abcdefghij ", k=300_000))
    docs = frame(spark, [(1, long), (2, "head" + long[100_000:100_500] + "tail")])
    spans = shared_spans(docs)
    assert rows_of(spans) == [(1, 100_000, 100_500), (2, 4, 504)]
    assert rows_of(shared_amount(docs, spans), "doc_id", "n_chars", "shared_chars") == [(1, 300_000, 500), (2, 508, 500)]
    assert rows_of(shared_spans(docs.limit(0))) == []


def test_wavelet_ranks():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 13, 1000)
    tree = X.WaveletTree(x, 4)
    at, symbol = rng.integers(0, 1001, 300), rng.integers(0, 16, 300)
    assert tree.rank(symbol, at).tolist() == [int((x[:a] == s).sum()) for a, s in zip(at, symbol, strict=True)]


def test_suffix_order_and_prefixes():
    rng = np.random.default_rng(3)
    segments = [rng.integers(1, 4, n) for n in (40, 1, 25, 40)]
    segments[3] = segments[0].copy()
    index = X.SegmentIndex(segments)
    text = np.concatenate([np.concatenate([s + 10, [i]]) for i, s in enumerate(segments)]).tolist()
    wanted = sorted(range(len(text)), key=lambda i: text[i:])
    assert index.order.tolist() == wanted
    for i in range(1, len(wanted)):
        a, b = text[wanted[i - 1] :], text[wanted[i] :]
        n = next(k for k in range(len(text)) if k >= min(len(a), len(b)) or a[k] != b[k])
        assert index.common[i] == n


def test_one_id_with_two_texts(spark, rows_of):
    rng = random.Random(8)
    part = "".join(rng.choice("abcdefghij") for _ in range(100))
    docs = [(1, "x" * 70 + part), (1, "other" * 40), (2, part)]
    assert rows_of(shared_spans(frame(spark, docs), least=60)) == [(1, 70, 170), (2, 0, 100)]
