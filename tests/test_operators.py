import hashlib
import json
import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from babelframe import session
from babelframe.operators import codeswitch as C
from babelframe.operators import ordering as O
from babelframe.operators import retrieval as R
from babelframe.operators import skew
from babelframe.operators import topics as Q
from babelframe.operators import translation as X


def test_lexicon(spark):
    rows = [(0, " House ", '["maison"," demeure "]'), (1, "CAT", '"chat"'), (2, "", '["x"]'), (3, "empty", "[]"), (4, "n", "null"), (5, "cat", '["", "minet", null]'), (6, "two words", '["a"]')]
    got = {r["word"]: r["candidates"] for r in C.normalized_lexicon(spark.createDataFrame(rows, "pos bigint, key string, value string")).collect()}
    assert got == {"house": ["maison", "demeure"], "cat": ["minet"], "two words": ["a"]}


def test_code_switching(spark):
    lexicon = spark.createDataFrame([("the", ["le"]), ("house", ["maison", "demeure"])], "word string, candidates array<string>")
    rows = spark.createDataFrame([("1", "The  HOUSE is"), ("2", "no  hit\there"), ("3", ""), ("4", None), ("5", "the two words")], "row_key string, text string")
    off = {r["row_key"]: (r["text"], r["n_switches"]) for r in C.switched(rows, lexicon, 0.0).collect()}
    assert off == {"1": ("The  HOUSE is", 0), "2": ("no  hit\there", 0), "3": ("", 0), "4": (None, 0), "5": ("the two words", 0)}
    on = {r["row_key"]: (r["text"], r["n_switches"]) for r in C.switched(rows, lexicon, 1.0).collect()}
    assert on["1"] in [("Le MAISON is", 2), ("Le DEMEURE is", 2)] and on["2"] == ("no  hit\there", 0) and on["5"] == ("le two words", 1)
    again = {r["row_key"]: (r["text"], r["n_switches"]) for r in C.switched(rows.repartition(3), lexicon, 1.0).collect()}
    assert again == on
    literal = rows.select("row_key", C.switched_in_row("text", {"the": ["le"], "house": ["maison", "demeure"]}, 1.0, 13, "row_key").alias("t")).where("row_key = '1'").first()
    assert literal["t"] == on["1"][0]
    words = spark.createDataFrame([("1", "See “the house”, (HOUSE)!  Don't")], "row_key string, text string")
    assert C.switched(words, lexicon.where("word = 'house'").withColumn("candidates", F.array(F.lit("logis"))), 1.0, tokenizer="words").first()["text"] == "See “the logis ”, (LOGIS)! Don't".replace(" ”", "”")
    table = spark.createDataFrame([("1", ["q1", "x", "the"]), ("2", ["the"]), ("3", []), ("4", ["q", "none"])], "row_key string, cols array<string>")
    got = {r["row_key"]: (r["cols"], r["n_switches"]) for r in C.switched_columns(table, lexicon, probability=1.0).collect()}
    assert got == {"1": (["q1", "x", "le"], 1), "2": (["the"], 0), "3": ([], 0), "4": (["q", "none"], 0)}
    stats = C.switch_statistics(C.switched(rows, lexicon, 1.0)).first()
    assert (stats["total_rows"], stats["switched_rows"], stats["switches"], stats["rate"], stats["per_switched_row"]) == (5, 2, 3, 40.0, 1.5)
    assert tuple(C.switch_statistics(C.switched(rows.limit(0), lexicon)).first()) == (0, 0, 0, 0.0, 0.0)


def test_topics(spark):
    kind = "row_no bigint, topic_id string, topics array<struct<lang:string,topic_title:string,topic_description:string>>"
    rows = [(1, "1", [("eng", " t ", "d"), None, (None, "x", "y")]), (2, "1", [("eng", "new", None)]), (3, "2", None), (4, "3", [("rus", "r", ""), ("rus", "r2", "")])]
    got = sorted(tuple(r) for r in Q.topics_by_language(spark.createDataFrame(rows, kind)).collect())
    assert got == [("1", "eng", "new", "", 1), ("3", "rus", "r2", "", 4)]
    views = Q.views(spark.createDataFrame([("t", None)], "title string, description string"), with_description=False).first()
    assert tuple(views) == ("t", "", "t ")


def test_judged_queries(spark):
    j = spark.createDataFrame([("zho", "1", "1"), ("zho", "2", "0"), ("fas", "1", "00"), ("fas", None, "1"), ("eng", "1", "-1")], "lang string, query_id string, relevance string")
    judged = Q.judged_ids(j, ["lang", "query_id"])
    assert sorted(tuple(r) for r in judged.collect()) == [("eng", "1"), ("fas", "1"), ("zho", "1")]
    queries = spark.createDataFrame([("1", "zho"), ("2", "zho"), ("1", "eng"), ("2", "eng")], "topic_id string, lang string")
    assert sorted(tuple(r) for r in Q.judged_queries(queries, judged).select("lang", "topic_id").collect()) == [("eng", "1"), ("zho", "1")]
    assert sorted(tuple(r) for r in Q.english_for_targets(queries, judged).select("target_lang", "topic_id").collect()) == [("fas", "1"), ("zho", "1")]


def test_aggregated_judgments(spark):
    rows = [("C001", "LA1", "1"), ("C001", "LA1", "2"), ("C001", "GH1", "1"), ("C002", "LA2", "0"), ("C300", "LA3", "1"), ("x", "LA4", "1"), ("C003", None, "1"), ("C004", "LA5", "bad")]
    df = spark.createDataFrame(rows, "query_id string, doc_id string, relevance string")
    assert sorted(tuple(r) for r in Q.aggregated_judgments(df, "LA").collect()) == [(1, "LA1"), (300, "LA3")]
    with pytest.raises(Exception, match="out of range"):
        Q.aggregated_judgments(df, "LA", 1, 200).collect()
    assert [Q.TOPIC_YEARS[y] for y in (2000, 2001)] == [(0, 40), (41, 90)] and Q.RANKING_YEARS[2001] == (0, 90)


def test_order_and_integrity(spark):
    docs = spark.createDataFrame([("a", 1, "A1"), ("a", 2, "A2"), ("b", 1, "B"), ("x", 1, "X")], "id string, at int, text string")
    last = O.last_wins(docs, ["id"], ["at"], ["text"])
    ids = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b")], "pos bigint, id string")
    assert [tuple(r) for r in O.reordered(ids, last).orderBy("pos").select("pos", "id", "text").collect()] == [(0, "b", "B"), (1, "a", "A2"), (2, "b", "B")]
    more = ids.union(spark.createDataFrame([(3, "gone")], ids.schema))
    assert [r[0] for r in O.missing_ids(more, docs).collect()] == ["gone"]
    with pytest.raises(Exception, match="listed document is missing: gone"):
        O.reordered(more, last).collect()
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    want = spark.createDataFrame([("a", md5("A2")), ("b", "no")], "id string, md5 string")
    assert [tuple(r) for r in O.hash_mismatches(last, want, F.lit(""), F.col("text")).collect()] == [("b", "no", md5("B"))]
    assert [r["shard"] for r in O.shard(ids, "pos", 2).orderBy("pos").collect()] == [0, 1, 0]


def test_bm25(spark):
    docs = [(1, "red fox red"), (2, "red dog"), (3, "cat"), (4, None), (5, "")]
    queries = [(10, "red fox fox"), (11, "nothing"), (12, None)]
    got = [tuple(r) for r in R.bm25(spark.createDataFrame(queries, "qid int, text string"), spark.createDataFrame(docs, "doc_id int, text string")).orderBy("rank").select("qid", "doc_id", "score", "rank").collect()]
    n, mean = 3, 2.0

    def part(df, tf, dl):
        return math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (0.6 + 0.4 * dl / mean))

    assert got == [(10, 1, round(part(2, 2, 3) + part(1, 1, 3), 4), 1), (10, 2, round(part(2, 1, 2), 4), 2)]
    assert R.bm25(spark.createDataFrame(queries, "qid int, text string"), spark.createDataFrame([], "doc_id int, text string")).count() == 0


def _scored(docs, queries, k):
    """All pairs scored one by one, the k best of each query."""
    sized = [(d, t.split()) for d, t in docs if d is not None and t]
    n, mean = len(sized), sum(len(w) for _, w in sized) / len(sized)
    df = Counter(t for _, w in sized for t in set(w))
    out = []
    for qid, text in queries:
        sums = Counter()
        for d, w in sized:
            for t in set(text.split()) & set(w):
                tf = w.count(t)
                sums[d] += math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf / (tf + 0.9 * (0.6 + 0.4 * len(w) / mean))
        best = sorted((-round(v, 4), d) for d, v in sums.items())[:k]
        out += [(qid, d, -v, i + 1) for i, (v, d) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("k, seed_rows, hot_rows", [(1, 1, 100_000), (3, 0, 100_000), (3, 5, 10), (50, 1, 100_000)])
def test_bm25_leaves_out_nothing_that_counts(spark, k, seed_rows, hot_rows):
    draw = random.Random(k)
    words = [f"w{int(60 * draw.random() ** 3)}" for _ in range(5000)]
    docs = [(i, " ".join(words[at : at + draw.randrange(1, 40)])) for i, at in enumerate(draw.randrange(4900) for _ in range(150))]
    docs += [(200 + i, t) for i, (_, t) in enumerate(docs[:20])]  # ties
    docs += [(5, "w0 w1 w59 w40"), (6, docs[6][1] + " w3 w59")]  # rows that add up
    queries = [(i, " ".join(draw.choice(words) for _ in range(n))) for i, n in enumerate([1, 2, 3, 8, 30])]
    d = spark.createDataFrame([*docs, (None, "w0 w50"), (9000, None)], "doc_id int, text string")
    q = spark.createDataFrame([*queries, (None, "w0"), (77, "")], "qid int, text string")
    got = R.bm25(q, d, k, hot_rows=hot_rows, seed_rows=seed_rows).select("qid", "doc_id", "score", "rank").collect()
    assert sorted(map(tuple, got)) == _scored(docs, queries, k)


def test_bm25_never_stores_pairs(spark):
    def moved():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    draw = random.Random(7)
    texts = [(i, " ".join(f"w{draw.randrange(30)}" for _ in range(12))) for i in range(4000)]
    d, q = (spark.createDataFrame(rows, "id bigint, text string").cache() for rows in (texts, texts[:400]))
    assert (d.count(), q.count()) == (4000, 400)
    before = moved()
    got = R.bm25(q.withColumnRenamed("id", "qid"), d.withColumnRenamed("id", "doc_id"), 3).select("qid", "doc_id", "score", "rank").collect()
    assert moved() - before < 500_000  # nearly all 1,600,000 pairs share a term
    assert sorted(map(tuple, got)) == _scored(texts, texts[:400], 3)


def test_bm25_rows_that_go_on_do_not_grow_with_blocks(spark, monkeypatch):
    def moved():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    # many blocks, each in a file and a partition of its own
    many = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.maxPartitionBytes": "1m"}
    old = {x: spark.conf.get(x) for x in many}
    monkeypatch.setattr(R, "LEAST_CHUNK", 1)
    draw = random.Random(8)
    texts = [(i, " ".join(f"w{draw.randrange(30)}" for _ in range(12))) for i in range(1500)]
    d, q = (spark.createDataFrame(rows, "id bigint, text string").cache() for rows in (texts, texts[:300]))
    assert (d.count(), q.count()) == (1500, 300)
    try:
        for x, v in many.items():
            spark.conf.set(x, v)
        before = moved()
        got = R.bm25(q.withColumnRenamed("id", "qid"), d.withColumnRenamed("id", "doc_id"), 10, hot_rows=40).select("qid", "doc_id", "score", "rank").collect()
        assert moved() - before < 1_000_000  # 32 blocks at least, with 10 documents for each query
    finally:
        for x, v in old.items():
            spark.conf.set(x, v)
    assert sorted(map(tuple, got)) == _scored(texts, texts[:300], 10)


def test_bm25_gathers_queries_in_parts(spark, monkeypatch):
    monkeypatch.setattr(R, "ASKED_ROWS", 5)
    monkeypatch.setattr(R, "LEAST_CHUNK", 2)
    docs = [(f"d{i:02}", f"a{i % 3} b{i % 5} c") for i in range(40)]
    queries = [(f"q{i}", f"a{i % 4} c b{i}") for i in range(9)]
    d, q = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(queries, "qid string, text string")
    got = R.bm25(q, d, 2, hot_rows=7).select("qid", "doc_id", "score", "rank").collect()
    assert sorted(map(tuple, got)) == _scored(docs, queries, 2)


def test_bm25_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(R, "FLOOR_ROWS", 4)
    docs = [(f"d{i}", f"a{i % 3} b{i % 5} c") for i in range(40)] + [("d1", "c b1"), ("d2", "c b2 c c")]
    queries = [(f"q{i}", f"a{i % 4} c b{i}") for i in range(7)]
    d, q = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(queries, "qid string, text string")
    got = R.bm25(q, d, 2, hot_rows=7).select("qid", "doc_id", "score", "rank").collect()
    assert sorted(map(tuple, got)) == _scored(docs, queries, 2)
    assert R.bm25(q.where("qid = ''"), d).count() == 0


def test_dense(spark):
    v = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(50)] + [(90, None), (91, [0.0, 0.0]), (92, [1.0])], "doc_id bigint, embedding array<double>")
    q = v.where("doc_id in (3, 90, 7)").withColumnRenamed("doc_id", "qid")
    for block in (1024, 1, 7):
        got = {}
        for r in R.dense(q, v, 3, block).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append(r["doc_id"])
        want = {i: sorted(range(50), key=lambda j: (-round(math.cos(i - j), 6), j))[:3] for i in (3, 7)}
        assert got == want


def test_metrics(spark):
    ranking = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "a", 1)], "qid int, doc_id string, rank int")
    judged = spark.createDataFrame([(1, "a", 1), (1, "c", 2), (1, "d", 1), (1, "b", -1), (2, "x", 1), (3, "y", 0)], "qid int, doc_id string, rel int")
    dcg = 1 / math.log2(2) + 3 / math.log2(4)
    ideal = 3 / math.log2(2) + 1 / math.log2(3) + 1 / math.log2(4)
    assert {r[0]: r[1] for r in R.ndcg(ranking, judged).collect()} == {1: round(dcg / ideal, 4), 2: 0.0}
    assert {r[0]: r[1] for r in R.average_precision(ranking, judged).collect()} == {1: round((1 + 2 / 3) / 3, 4), 2: 0.0}
    assert {r[0]: r[1] for r in R.recall(ranking, judged).collect()} == {1: round(2 / 3, 4), 2: 0.0}
    assert {r[0]: r[1] for r in R.ndcg(judged.where("rel > 0").withColumn("rank", F.expr("case when doc_id = 'c' then 1 when doc_id = 'a' then 2 else 3 end")), judged).collect()} == {1: 1.0, 2: round(1 / 2, 4)}


def test_best_passage(spark):
    df = spark.createDataFrame([(1, "a_b_0", 1.0), (1, "a_b_11", 2.0), (1, "c_0", 0.5)], "qid int, original_id string, score double")
    assert sorted(tuple(r) for r in R.best_passage(df).collect()) == [(1, "a_b", 2.0), (1, "c", 0.5)]
    assert [r["doc_id"] for r in R.best_candidates(df.withColumnRenamed("original_id", "doc_id"), 2).orderBy("rank").collect()] == ["a_b_11", "a_b_0"]


def test_translation(spark):
    rows = spark.createDataFrame([("1", "The cat. A dog!"), ("2", None), ("3", " ")], "query_id string, text string")
    parts = X.query_sentences(rows)
    got = X.regrouped(X.translated(parts, lambda: X.word_by_word({"cat.": "chat."}), batch=1)).collect()
    assert [tuple(r) for r in got] == [("1", "The chat. A dog!")]
    assert [r["translation"] for r in X.translated(rows, lambda: lambda ts: [t.upper() for t in ts], "text").orderBy("query_id").collect()] == ["THE CAT. A DOG!", None, ""]


def test_plans(spark, tmp_path):
    spark.range(1000).selectExpr("cast(id as string) id", "'LA' || id as doc_id", "'1' relevance", "'C001' query_id").write.parquet(str(tmp_path / "q"))
    df = spark.read.parquet(str(tmp_path / "q"))
    plan = Q.aggregated_judgments(df, "LA")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(doc_id,LA)" in plan
    top = R.top_k(df.selectExpr("query_id qid", "doc_id", "id score"), "qid", 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in top
    assert json.dumps(top).count("BatchEvalPython") == 0


def test_numbers_over_several_partitions(spark, rows_of):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(g, i, (i * 7) % 3, "x") for g in ("a", "b", None, "hot") for i in range(400 if g == "hot" else 3)]
        df = spark.createDataFrame(rows, "g string, i int, n int, _m string").repartition(5)
        got = O.per_group_position(df.drop("_m"), "g", ["i"])
        assert sorted((r["g"] or "", r["i"], r["pos"]) for r in got.collect()) == sorted((g or "", i, i) for g, i, *_ in rows)
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
        want = {(r[0], r[1]): sum(x[2] for x in order[:k]) for k, r in enumerate(order)}
        assert {(r["g"], r["i"]): r["at"] for r in O.numbered(df.drop("_m"), ["g", "i"], "at", weight="n").collect()} == want
        assert {(r["g"], r["i"]): r["at"] for r in O.numbered(df.drop("_m"), ["g", "i"], "at").collect()} == {(r[0], r[1]): k for k, r in enumerate(order)}
        assert O.per_group_position(df.drop("_m").limit(0), "g", ["i"]).count() == 0
        assert O.numbered(df.drop("_m").limit(0), ["g"], weight="n").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hot_keys_are_few_and_sliced(spark):
    df = spark.createDataFrame([(("hot" if i % 3 else f"k{i}"), i) for i in range(3000)], "k string, i int")
    hot = skew.hot_keys(df, ["k"], 100)
    assert len(hot) == 1 and 15 <= hot[0][1] <= 25
    few = df.select("k").distinct().withColumn("v", F.length("k"))
    got = skew.sliced_join(df, few, ["k"], hot, ["i"])
    assert got.count() == 3000 and sorted(got.columns) == ["i", "k", "v"]
    assert skew.sliced(df, ["k"], hot, ["i"]).where("k = 'hot'").select("slice").distinct().count() == hot[0][1]
    assert skew.hot_keys(df.limit(0), ["k"], 1) == []


def test_scratch_removes_what_was_stored(spark):
    with session.scratch(spark):
        kept = session.stored(spark.range(5))
        path = kept.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path) and kept.count() == 5
    assert not os.path.exists(os.path.dirname(path))
