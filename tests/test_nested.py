import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from babelframe.operators import nested as N

RECORD = {
    "topic_id": 7,
    "topics": [
        {"lang": "eng", "narratives": [{"kind": "a"}, None, {"kind": "a"}], "note": '[{"x": 1}]'},
        None,
        "see file",
        '{"lang": "deu", "narratives": {"kind": "a"}}',
    ],
    "meta": {"history": json.dumps([{"by": {"desk": 1}, "changes": [{"old": "o"}]}])},
    "flags": ["x"],
}


def paths(df):
    return sorted(r[0] for r in df.where("in_list").select("node_path").collect())


def frame(spark, *payloads):
    return spark.createDataFrame([(i, p, "clash") for i, p in enumerate(payloads)], "row_no bigint, payload string, node_path string")


def test_paths(spark):
    got = N.flatten_records(frame(spark, json.dumps(RECORD)), "row_no", "payload")
    assert paths(got) == sorted(["topics/0", "topics/0/narratives/0", "topics/0/narratives/2", "topics/3", "topics/3/narratives/0", "meta/history/0", "meta/history/0/changes/0"])


def test_unreadable_payloads_give_nothing(spark):
    bad = [None, "", "[1]", "3", '{"a": NaN}', "{'a': 1}", '{"topics": [{}', '{"a": 1} x', '"text"', '{"a": "\t"}']
    assert N.flatten_records(frame(spark, *bad), "row_no", "payload").count() == 0
    assert N.flatten_records(frame(spark).limit(0), "row_no", "payload").count() == 0


def test_record_in_a_string(spark):
    assert paths(N.flatten_records(frame(spark, json.dumps(json.dumps({"topics": [{}]}))), "row_no", "payload")) == ["topics/0"]


def test_parts_in_strings(spark):
    record = {"meta": json.dumps({"history": [{}]}), "topics": [], "note": json.dumps({"points": [{}]})}
    assert paths(N.flatten_records(frame(spark, json.dumps(record)), "row_no", "payload")) == ["meta/history/0"]


def test_equal_subtrees_are_stored_once(spark):
    nodes = N.flatten_records(frame(spark, json.dumps(RECORD), json.dumps(dict(reversed(RECORD.items())))), "row_no", "payload").cache()
    one, two = (nodes.where(f"row_no = {i} and node_path = ''").first()["node_hash"] for i in (0, 1))
    assert one == two  # order of members plays no part
    assert nodes.where("list_key = 'narratives'").select("node_hash").distinct().count() == 1
    bodies = {r["node_hash"]: r["body"] for r in N.objects(nodes).collect()}
    places = N.bridge(nodes).where("row_no = 0").collect()
    assert len(places) == nodes.count() / 2 and len(bodies) < len(places)
    # the links lead from every object to the root, and the bodies build the record again
    by_path = {r["node_path"]: r for r in places}
    for r in places:
        if r["parent_path"] is not None:
            assert by_path[r["parent_path"]]["node_hash"] == r["parent_hash"]

    def build(h):
        def open_(x):
            return build(x["$"]) if isinstance(x, dict) else [open_(y) for y in x] if isinstance(x, list) else x

        return {k: open_(v) for k, v in json.loads(bodies[h]).items()}

    assert build(one)["topics"][0]["narratives"] == RECORD["topics"][0]["narratives"]
    assert build(one)["meta"]["history"] == json.loads(RECORD["meta"]["history"])


def test_depth_and_length(spark):
    deep = '{"points": [' * 3000 + "{}" + "]}" * 3000
    assert N.flatten_records(frame(spark, deep), "row_no", "payload").where("in_list").count() == 3000
    lists = '{"topic_id": 3, "x": ' + "[" * 100_000 + '{"a": 1}' + "]" * 100_000 + "}"
    got = N.flatten_records(frame(spark, lists), "row_no", "payload").select("record_key", "in_list", F.length("node_path")).collect()
    assert sorted(map(tuple, got)) == [("3", False, 0), ("3", True, 200_001)]
    assert N.flatten_records(frame(spark, lists[:-1] + "]"), "row_no", "payload").count() == 0
    long = json.dumps({"topics": [{"n": 1, "t": "x" * 1_000_000}], "big": 0})[:-2] + "1" * 5000 + "}"
    assert paths(N.flatten_records(frame(spark, long), "row_no", "payload")) == ["topics/0"]


SOUND = ["[]", "{}", "[[], {}]", ' {"a": [1, 2, {"b": null}], "c": "x\\u00e9"} ', '"s"', "-1.5e3", "[true, false]", '{"a": 1, "a": 2}']
BROKEN = ["[1,]", '{"a": 1,}', '{"a" 1}', "[1 2]", '{"a": [}', "", "[", "]", '{"a": 1}}', '["a", "b"', "{,}", "[,1]", "[01]", "[1.]", "[NaN]", "{1: 2}", '["\t"]', "[tru]"]


def test_own_parser_agrees_with_the_standard_one():
    for text in SOUND:
        assert N._parse_deep(text) == N.parse_json(text)
    for text in BROKEN:
        for parse in (N._parse_deep, N.parse_json):
            with pytest.raises(ValueError):
                parse(text)


def test_numbers_keep_their_value():
    same = [["1.5", "1.50", "15e-1", "0.15E+1"], ["0", "-0", "0.0", "0e5"], ["100", "1e2", "100.0"]]
    for group in same:
        assert len({N.number(x) for x in group}) == 1
    other = ["12345678901234567.1", "12345678901234567.4", "1e999", "2e999", "-1", "1", "0.001", "1e-50"]
    assert len({N.number(x) for x in other}) == len(other)
    for x in ["1.50", "-12.5", "1e999", "123e45", "0.001", "1e-50", "7"]:
        assert Decimal(N.number(x)) == Decimal(x)


def test_identities_of_numbers_and_odd_keys(spark):
    texts = ['{"topics": [{"n": 12345678901234567.1}]}', '{"topics": [{"n": 12345678901234567.4}]}', '{"topics": [{"n": 1.0}]}', '{"topics": [{"n": 1}]}', '{"\\ud800": [{"n": 1}]}']
    got = N.flatten_records(frame(spark, *texts), "row_no", "payload").where("in_list").orderBy("row_no").collect()
    assert len({r["node_hash"] for r in got}) == 3 and got[2]["node_hash"] == got[3]["node_hash"] == got[4]["node_hash"]
    assert got[4]["node_path"] == "\\ud800/0"


def test_links_and_level_tables(spark, rows_of):
    nodes = N.flatten_records(frame(spark, json.dumps(RECORD)), "row_no", "payload", tab_name="a").unionByName(N.flatten_records(frame(spark, json.dumps(RECORD)), "row_no", "payload", tab_name="b"))
    links = N.bridge(nodes).cache()
    assert links.select("tab_name", "row_no", "node_path").distinct().count() == links.count()
    rows = rows_of(N.level(nodes, "narratives", "kind string, extra bigint").where("tab_name = 'b'"), "record_key", "parent_path", "ordinal", "kind")
    assert rows == [("7", "topics/0", 0, "a"), ("7", "topics/0", 2, "a"), ("7", "topics/3", 0, "a")]
    top = N.level(nodes, "topics", "lang string, note string").select("tab_name", "node_path", "lang", N.member("none").alias("m")).orderBy("tab_name", "node_path").collect()
    assert [tuple(r) for r in top] == [(t, p, x, None) for t in "ab" for p, x in (("topics/0", "eng"), ("topics/3", "deu"))]
    by = nodes.where("list_key = 'history' and in_list").select(N.member("by").alias("h")).distinct().collect()
    assert [r["h"] for r in by] == [r["node_hash"] for r in nodes.where("list_key = 'by'").select("node_hash").distinct().collect()]


def test_typed_topics(spark, rows_of):
    kind = "row_no bigint, topic_id string, topics array<struct<lang:string,topic_title:string,topic_description:string>>"
    df = spark.createDataFrame([(1, "a", [("eng", "t", None), None, (None, None, None)]), (2, None, None), (3, "c", []), (1, "a", [("eng", "t", None)])], kind)
    got = N.flatten_topics(df)
    assert rows_of(N.level(got, "topics", "lang string"), "row_no", "node_path") == [(1, "topics/0"), (1, "topics/0"), (1, "topics/2")]
