import math
import random

import pytest

from babelframe.operators import ordering as O
from babelframe.operators import passages as P

WINDOWS = {0: [(0, 0)], 1: [(0, 1)], 90: [(0, 90)], 91: [(0, 91), (90, 91)], 180: [(0, 180), (90, 180)], 181: [(0, 180), (90, 181), (180, 181)], 271: [(0, 180), (90, 270), (180, 271), (270, 271)]}


def frame(spark, sizes):
    return spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in sizes] + [(-1, None)], "doc_id bigint, text string")


def test_windows(spark):
    got = {}
    for r in P.passages(frame(spark, WINDOWS)).orderBy("doc_id", "k").collect():
        w = r["passage"].split()
        start = int(w[0][1:]) if w else 0
        got.setdefault(r["doc_id"], []).append((start, start + len(w)))
    assert got == WINDOWS
    counts = {r["doc_id"]: r["n_passages"] for r in P.passage_counts(frame(spark, WINDOWS)).collect()}
    assert counts == {n: 1 if n <= 90 else math.ceil(n / 90) for n in WINDOWS}


def test_overlap_must_be_smaller(spark):
    for overlap in (180, 181):
        with pytest.raises(ValueError):
            P.passages(frame(spark, [1]), 180, overlap)


def test_offsets_keep_the_text(spark):
    text = "  a\t b\n\nc  d é  f "
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "x  y")], "doc_id bigint, text string")
    got = [tuple(r) for r in P.offset_passages(df, length=3, overlap=2).orderBy("doc_id", "k").collect()]
    assert got == [(1, 0, "a\t b\n\nc"), (1, 1, "b\n\nc  d"), (1, 2, "c  d é"), (1, 3, "d é  f"), (1, 4, "é  f"), (1, 5, "f"), (2, 0, ""), (4, 0, "x  y")]


def test_dense_numbers(spark):
    rng = random.Random(4)
    docs = frame(spark, rng.sample(range(400), 60)).repartition(5)
    got = P.numbered_passages(P.passages(docs)).collect()
    order = sorted(got, key=lambda r: (r["doc_id"], r["k"]))
    assert [r["passage_idx"] for r in order] == list(range(len(got)))
    assert all(r["original_id"] == f"{r['doc_id']}_{r['k']}" for r in got)
    assert O.numbered(docs.limit(0), ["doc_id"]).count() == 0


def test_numbering_plan_has_no_single_task(spark):
    df = O.numbered(spark.range(1000).repartition(4), ["id"])
    big = df.where("id >= 0")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in big and "CartesianProduct" not in big


def test_positions_in_groups(spark):
    df = spark.createDataFrame([(g, i) for g in "aab" for i in range(5)][5:] + [("c", 9)], "g string, i int")
    got = {(r["g"], r["i"]): r["pos"] for r in O.per_group_position(df, "g", ["i"]).collect()}
    assert got == {**{(g, i): i for g in "ab" for i in range(5)}, ("c", 9): 0}
