from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from babelframe.operators.references import orphan_references, qrels_orphans

QRELS = "qrel_id bigint, query_id string, iter string, doc_id string, relevance string, judged_at timestamp, loaded_at timestamp, key string, slice int, t string"
DOCS = "doc_id string, documents string, lang string, coll_year int, loaded_at timestamp, deleted_at timestamp, kind int"
TOPICS = "row_no bigint, topic_id string, topics string, loaded_at timestamp, deleted_at timestamp"


def q(i, query, doc, at):
    return (i, query, "0", doc, "1", at, None, "x", 1, "y")


@pytest.fixture(scope="module")
def parents(spark):
    docs = [
        ("A", "", "eng", 2000, D(2022, 1, 1), None, 1),
        ("A", "", "eng", 2000, D(2022, 1, 1), None, 1),
        ("B", "", "eng", 2000, D(2022, 1, 1), D(2022, 2, 1), 1),
        ("B", "", "eng", 2000, D(2022, 3, 1), None, 1),
        ("C", "", "eng", 2000, D(2022, 5, 1), None, 1),
        ("E", "", "eng", 2000, D(2022, 5, 1), D(2022, 4, 1), 1),
        ("N", "", "eng", 2000, None, None, 1),
        (None, "", "eng", 2000, D(2022, 1, 1), None, 1),
    ]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, "T", None, D(2022, 1, 1), None)], TOPICS)


CASES = [
    q(1, "T", "A", D(2022, 1, 1)),  # at the very start: in force
    q(2, "T", "A", D(2021, 12, 31)),  # late, and the topic too
    q(3, "T", " B ", D(2022, 1, 15)),  # padded
    q(4, "T", "B", D(2022, 2, 1)),  # deleted at that moment
    q(5, "T", "B", D(2022, 3, 1)),
    q(6, "T", "C", D(2022, 4, 30)),
    q(7, "T", "X", D(2022, 4, 30)),
    q(8, "T", "C", None),
    q(9, "T", "X", None),
    q(10, None, None, D(2022, 4, 30)),
    q(11, "T", "", D(2022, 4, 30)),
    q(12, "T", "E", D(2022, 6, 1)),  # deleted before it was loaded
    q(13, "T", "N", D(2022, 6, 1)),  # never loaded, though known
    q(13, "T", "X", D(2022, 6, 1)),
]
WANTED = [
    ("doc_id", "2021-12", 2, "late"),
    ("doc_id", "2022-02", 4, "deleted"),
    ("doc_id", "2022-04", 6, "late"),
    ("doc_id", "2022-04", 7, "missing"),
    ("doc_id", "2022-04", 11, "missing"),
    ("doc_id", "2022-06", 12, "deleted"),
    ("doc_id", "2022-06", 13, "late"),
    ("doc_id", "2022-06", 13, "missing"),
    ("doc_id", "none", 9, "missing"),
    ("query_id", "2021-12", 2, "late"),
]


def test_reasons_and_periods(spark, parents, rows_of):
    assert rows_of(qrels_orphans(spark.createDataFrame(CASES, QRELS), *parents)) == sorted(WANTED)


def test_hot_keys_in_slices(spark, parents, rows_of):
    refs = spark.createDataFrame(CASES * 3, QRELS)
    own = dict(ref_id="qrel_id", ref_key=F.col("doc_id"), ref_time=F.col("judged_at"), parent_key=F.col("doc_id"), valid_from=F.col("loaded_at"), valid_to=F.col("deleted_at"))
    whole = rows_of(orphan_references(refs, parents[0], **own), "ref_id", "reason")
    assert rows_of(orphan_references(refs, parents[0], **own, hot_key_rows=2), "ref_id", "reason") == whole
    assert len(whole) == 3 * sum(w[0] == "doc_id" for w in WANTED)


def test_empty_tables(spark, parents, rows_of):
    none = spark.createDataFrame([], QRELS)
    assert rows_of(qrels_orphans(none, *parents)) == []
    got = qrels_orphans(spark.createDataFrame(CASES[:1], QRELS), spark.createDataFrame([], DOCS), spark.createDataFrame([], TOPICS))
    assert [r[3] for r in rows_of(got)] == ["missing", "missing"]
