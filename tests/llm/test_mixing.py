import os
import random

import pytest
from pyspark.sql import functions as F

from babelframe.llm import mixing as M

VOCABULARY = os.environ.get("BABELFRAME_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_multi_50k.tiktoken"
TARGET = "source string, target_share double, max_repeats int, used string"


def counts(spark, sizes):
    rng = random.Random(2)
    rows = [(s * 10**6 + i, name, rng.randint(1, 60)) for s, (name, n) in enumerate(sizes.items()) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


TARGETS = [("big", 0.5, 1, ""), ("mid", 0.3, 3, ""), ("small", 0.1, 4, ""), ("none", 0.1, 8, "")]


def test_shares_and_caps(spark):
    rows = counts(spark, {"big": 4000, "mid": 500, "small": 60, "other": 300})
    total = 60_000
    plan, hashed = M.mixture_plan(rows, spark.createDataFrame(TARGETS, TARGET), total)
    mixed = M.mixture(plan, hashed).cache()
    got = {r["source"]: r for r in M.shares(plan, mixed).collect()}
    for name, share, cap, _ in TARGETS:
        r = got[name]
        assert r["most_uses"] <= cap
        if r["falls_short"]:
            assert r["used"] == r["available"] * cap
        else:
            assert abs(r["used"] - share * total) <= 31
            assert abs(r["share_of_total"] - share) <= 31 / total
    assert got["none"]["falls_short"] and got["none"]["used"] == 0 and got["small"]["falls_short"] == (got["small"]["available"] * 4 < 6000)
    assert mixed.where("source = 'other'").count() == 0
    assert abs(sum(r["actual_share"] for r in got.values()) - 1) < 1e-9
    uses = {r["uses"] for r in mixed.where("source = 'mid'").select("uses").distinct().collect()}
    assert max(uses) - min(uses) <= 1


def test_smaller_mixture_is_part_of_the_larger(spark):
    rows = counts(spark, {"big": 2000, "mid": 500, "small": 60})
    targets = spark.createDataFrame(TARGETS, TARGET)
    small, large = ({r["doc_id"]: r["uses"] for r in M.mixture(*M.mixture_plan(rows, targets, n)).collect()} for n in (10_000, 25_000))
    assert all(large.get(k, 0) >= n for k, n in small.items()) and len(small) < len(large)


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, "big", 0), (3, "big", 7), (3, "big", 7), (None, "mid", 4)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.4, 1, ""), ("big", 0.1, 2, ""), (None, 0.3, 1, ""), ("mid", None, 1, ""), ("low", -1.0, 1, "")], TARGET)
    plan, hashed = M.mixture_plan(rows, targets, 1000)
    assert [(r["source"], r["max_repeats"], r["available"]) for r in plan.collect()] == [("big", 1, 14)]
    assert sorted(r["doc_id"] for r in M.mixture(plan, hashed).collect()) == [3, 3]
    plan, hashed = M.mixture_plan(rows.limit(0), targets)
    assert M.mixture(plan, hashed).count() == 0 and M.shares(plan, M.mixture(plan, hashed)).first()["used"] == 0
    plan, hashed = M.mixture_plan(rows, targets.limit(0))
    assert plan.count() == 0 and M.mixture(plan, hashed).count() == 0


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_token_counts(spark):
    docs = spark.createDataFrame([(1, "a", "hello world", "x"), (2, "a", None, "x"), (3, None, "", "x"), (4, "b", "слово " * 50_000, "x")], "doc_id bigint, source string, text string, n_tokens string")
    got = {r["doc_id"]: r["n_tokens"] for r in M.token_counts(docs, M.Tokenizer(VOCABULARY)).collect()}
    assert got[1] == len(M._encoding(VOCABULARY, M.PATTERN).encode_ordinary("hello world")) and got[2] == got[3] == 0 and got[4] >= 50_000
    assert M.token_counts(docs, M.Tokenizer(VOCABULARY)).agg(F.count("*")).first()[0] == 4


def test_against_sorting(spark):
    """The same records as when each source's records are sorted by hash and taken until the budget is met, to the nearer side."""
    rows = counts(spark, {"big": 3000, "mid": 400, "small": 60})
    total = 40_000
    plan, hashed = M.mixture_plan(rows, spark.createDataFrame(TARGETS, TARGET), total)
    got = {r["doc_id"]: r["uses"] for r in M.mixture(plan, hashed).collect()}
    want: dict[int, int] = {}
    by = {}
    for r in hashed.select("source", "doc_id", "n_tokens", "h").collect():
        by.setdefault(r["source"], []).append((r["h"] % 2**64, r["doc_id"], r["n_tokens"]))
    for name, share, cap, _ in TARGETS:
        own = sorted(by.get(name, []))
        available, budget = sum(x[2] for x in own), int(share * total)
        full = min(budget // available, cap) if available else 0
        rest = budget - full * available if full < cap else 0
        for _, doc, n in own:
            take = n <= rest or 2 * rest >= n and rest > 0
            want[doc] = full + (1 if take else 0)
            rest = rest - n if n <= rest else 0
    assert got == {k: n for k, n in want.items() if n} and len(got) > 500


def test_uses_of_whole_sources(spark):
    rows = spark.createDataFrame([(i, "a", 10) for i in range(10)], "doc_id bigint, source string, n_tokens bigint")
    for total, used in ((96, 100), (104, 100), (100, 100), (196, 200), (1000, 300), (4, 0), (5, 10)):
        plan, hashed = M.mixture_plan(rows, spark.createDataFrame([("a", 1.0, 3, "")], TARGET), total)
        got = M.mixture(plan, hashed).agg(F.sum(F.col("n_tokens") * F.col("uses"))).first()[0] or 0
        assert got == used, total
