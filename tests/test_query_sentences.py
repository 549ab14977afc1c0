import __spark_entry__ as entry


def test_sentences_of_all_queries(spark, tmp_path):
    """Every title and description of process_queries is split, with its row's key."""
    rows = [("C001", "en", 2000, "One. Two!", None), ("C002", "de", 2001, " ", "Eins? Zwei. Drei"), (None, None, None, "Alone", "")]
    spark.createDataFrame(rows, "query_id string, lang string, coll_year int, titles string, descs string").write.parquet(f"{tmp_path}/process_queries.parquet")
    got = {tuple(r) for r in entry.queries()["sentence_explode_queries"](spark, str(tmp_path)).select("query_id", "field", "sent_no", "sentence").collect()}
    want = {("C001", "titles", 0, "One."), ("C001", "titles", 1, "Two!"), (None, "titles", 0, "Alone")}
    assert got == want | {("C002", "descs", i, s) for i, s in enumerate(("Eins?", "Zwei.", "Drei"))}
