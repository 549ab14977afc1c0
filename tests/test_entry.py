import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_names_match():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50
    assert {f"p{n}_found" for n in (2, 3, 5)} <= set(queries)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_core_queries_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in os.listdir(SMALL):
        con.execute(f"create view {name[:-8]} as select * from '{SMALL}/{name}'")
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in ("p2_found", "p2_sound", "p3_topic_rows", "p5_found", "p5_report", "clean_text", "passages_ws", "passage_mapping", "sgml_extract", "jsonl_normalize", "qrels_grouped", "queries_judged", "queries_aggregate", "codeswitch_queries", "bm25_topk", "dense_topk", "metric_ndcg20"):
        df = queries[name](spark, SMALL)
        cols = sorted(df.columns)
        rel = con.execute(sql[name])
        heads = [x[0] for x in rel.description]
        got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
        want = sorted(tuple(str(r[heads.index(c)]) for c in cols) for r in rel.fetchall())
        assert sorted(heads) == cols and got == want, name
