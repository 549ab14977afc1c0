import duckdb
import pytest

import __spark_entry__ as e
from babelframe.session import scratch

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["bm25_titles", "metric_bm25_ndcg20"])
def test_title_runs_shuffle_texts_and_not_pairs(spark, name):
    def moved():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    con = duckdb.connect()
    for t in ("topics", "load_documents", "qrels"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    sql = con.execute(e.oracle_sql()[name])
    heads = [x[0] for x in sql.description]
    before = moved()
    with scratch(spark):
        got = sorted(tuple(r) for r in e.queries()[name](spark, D).select(heads).collect())
    assert moved() - before < 2_500_000
    assert got == sorted(sql.fetchall())
