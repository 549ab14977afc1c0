"""Registered queries for the general data problems (2, 3 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested, references
from ..session import table
from ..sources import judgments


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return judgments.rejected_lines(judgments.parse_lines(table(spark, d, "qrels_lines")))


def p2_sound(spark: SparkSession, d: str) -> DataFrame:
    return judgments.sound_lines(judgments.parse_lines(table(spark, d, "qrels_lines")))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    a = nested.flatten_topics(table(spark, d, "topics"))
    return a.unionByName(nested.flatten_records(table(spark, d, "topic_records"), "row_no", "payload", tab_name="topic_records"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).where("in_list").select("tab_name", "row_no", "node_path")


def p3_objects(spark: SparkSession, d: str) -> DataFrame:
    return nested.objects(_nodes(spark, d))


def p3_bridge(spark: SparkSession, d: str) -> DataFrame:
    return nested.bridge(_nodes(spark, d))


#: Scalar members of each level's objects.
LEVELS = {
    "topics": "lang string, topic_title string, topic_description string",
    "narratives": "kind string",
    "points": "point_no bigint, text string",
    "history": "",
    "changes": "field string, old string",
}


def _level(spark: SparkSession, d: str, key: str) -> DataFrame:
    """The flat table of a level in both tables: its place, the topic_id above, the parent's path and its own columns."""
    got = nested.level(_nodes(spark, d), key, LEVELS[key] or "_ string").withColumnRenamed("record_key", "topic_id")
    return got.select("tab_name", "row_no", "topic_id", "parent_path", "node_path", F.col("ordinal").cast("bigint").alias("ordinal"), *[x.split()[0] for x in LEVELS[key].split(", ") if x], "body")


def p3_topic_rows(spark: SparkSession, d: str) -> DataFrame:
    """The level `topics` of the typed table with its parent's key."""
    got = nested.level(nested.flatten_topics(table(spark, d, "topics")), "topics", LEVELS["topics"])
    return got.select("row_no", F.col("record_key").alias("topic_id"), F.col("ordinal").cast("bigint").alias("ordinal"), "lang", "topic_title", "topic_description")


def p3_topics(spark: SparkSession, d: str) -> DataFrame:
    return _level(spark, d, "topics").drop("body")


def p3_narratives(spark: SparkSession, d: str) -> DataFrame:
    return _level(spark, d, "narratives").drop("body")


def p3_points(spark: SparkSession, d: str) -> DataFrame:
    return _level(spark, d, "points").drop("body")


def p3_history(spark: SparkSession, d: str) -> DataFrame:
    """Each entry with the object under `by`, which is stored once however often it stands in entries."""
    nodes = _nodes(spark, d)
    by = nodes.where("list_key = 'by' and not in_list").select("tab_name", "row_no", F.col("parent_path").alias("node_path"), F.from_json("body", "role string, desk bigint").alias("by"))
    return _level(spark, d, "history").drop("body").join(by, ["tab_name", "row_no", "node_path"], "left").select("tab_name", "row_no", "topic_id", "parent_path", "node_path", "ordinal", "by.role", "by.desk")


def p3_changes(spark: SparkSession, d: str) -> DataFrame:
    return _level(spark, d, "changes").drop("body")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.qrels_orphans(table(spark, d, "qrels"), table(spark, d, "load_documents"), table(spark, d, "topics"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).drop("reason")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).groupBy("ref_field", "judged_month", "reason").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (p2_found, p2_sound, p3_found, p3_objects, p3_bridge, p3_topic_rows, p3_topics, p3_narratives, p3_points, p3_history, p3_changes, p5_found, p5_report)}

_P5 = """
with docs as (select distinct doc_id k, loaded_at a, deleted_at b from load_documents where doc_id is not null),
tops as (select distinct topic_id k, loaded_at a, deleted_at b from topics where topic_id is not null),
r as (select 'doc_id' ref_field, qrel_id, trim(doc_id) k, judged_at t from qrels where doc_id is not null
      union all select 'query_id', qrel_id, trim(query_id), judged_at from qrels where query_id is not null),
p as (select 'doc_id' ref_field, * from docs union all select 'query_id', * from tops),
j as (select r.ref_field, r.qrel_id, r.t, count(p.k) known, count(case when p.a <= r.t then 1 end) begun,
             count(case when p.a <= r.t and (p.b is null or p.b > r.t) then 1 end) live
      from r left join p on p.ref_field = r.ref_field and p.k = r.k group by 1, 2, 3),
o as (select ref_field, coalesce(strftime(t, '%Y-%m'), 'none') judged_month, qrel_id,
             case when known = 0 then 'missing' when begun = 0 then 'late' else 'deleted' end reason
      from j where case when t is null then known = 0 else live = 0 end)
"""
_P2 = r"""
with q as (select line_no, trim(regexp_replace(raw_line, '\r$', ''), ' ' || chr(9)) s from qrels_lines),
k as (select line_no, s, regexp_full_match(s, '((("([^"]|"")*")|[^" \t]+)([ \t]+|$))*', 's') quoted_well from q),
f as (select line_no, quoted_well, regexp_extract_all(s, '("([^"]|"")*")|([^" \t]+)') w from k),
g as (select line_no, quoted_well, len(w) n, [case when x[1] = '"' then replace(substr(x, 2, length(x) - 2), '""', '"') else x end for x in w] w from f),
v as (select *, n = 4 and regexp_full_match(w[3], '[A-Z]{2}[0-9]{6}-[0-9]{4,}') doc_ok, n = 4 and regexp_full_match(w[4], '-0*1|-?0+|0*[123]') rel_ok from g)
"""


def _opened(x: str) -> str:
    """JSON text held in a string as what it holds."""
    return f"case when json_type({x}) = 'VARCHAR' and regexp_matches({x}->>'$', '^[ \\t\\r\\n]*[{{\\[\"]') and json_valid({x}->>'$') then cast({x}->>'$' as json) else {x} end"


def _list_of(key: str, parent: str, name: str, step: str = "") -> str:
    """CTEs that end in `name` (row_no, topic_id, parent_path, node_path, ordinal, o): the objects in the list under a key of the parents."""
    return f"""
{name}0 as (select row_no, topic_id, node_path || case when node_path = '' then '' else '/' end || '{step}' parent_path, json_extract(o, '$.{key}') x from {parent}),
{name}1 as (select row_no, topic_id, rtrim(parent_path, '/') parent_path, {_opened('x')} x from {name}0),
{name}2 as (select row_no, topic_id, parent_path, {_opened('x')} x from {name}1),
{name}3 as (select row_no, topic_id, parent_path, case json_type(x) when 'ARRAY' then json_extract(x, '$[*]') when 'OBJECT' then [x] else [] end e from {name}2),
{name}4 as (select row_no, topic_id, parent_path, unnest(e) x, generate_subscripts(e, 1) - 1 ordinal from {name}3),
{name}5 as (select row_no, topic_id, parent_path, ordinal, x, {_opened('x')} y from {name}4),
{name} as (select row_no, topic_id, parent_path, parent_path || case when parent_path = '' then '' else '/' end || '{key}/' || ordinal node_path, ordinal, case json_type(x) when 'OBJECT' then x else y end o
           from {name}5 where json_type(x) = 'OBJECT' or json_type(y) = 'OBJECT')"""


_RECORDS = f"""
with a0 as (select row_no, case when json_valid(payload) then cast(payload as json) end x from topic_records where payload is not null),
a1 as (select row_no, {_opened('x')} o from a0 where x is not null),
r as (select row_no, o->>'$.topic_id' topic_id, '' node_path, o from a1 where json_type(o) = 'OBJECT')"""
_META = f"m0 as (select row_no, topic_id, node_path, json_extract(o, '$.meta') x from r), m as (select row_no, topic_id, node_path, {_opened('x')} o from m0)"
_PLACE = "'topic_records' tab_name, row_no, topic_id, parent_path, node_path, ordinal"
_TYPED = "select row_no, topic_id, i - 1 ordinal, t.lang lang, t.topic_title topic_title, t.topic_description topic_description from (select row_no, topic_id, unnest(topics) t, generate_subscripts(topics, 1) i from topics) where t is not null"

ORACLE = {
    "p2_found": _P2 + """
select line_no, 'quoting' reason from v where not coalesce(quoted_well, true)
union all select line_no, 'column_count' from v where coalesce(quoted_well, true) and coalesce(n, 0) <> 4
union all select line_no, 'doc_id' from v where quoted_well and n = 4 and not doc_ok
union all select line_no, 'relevance' from v where quoted_well and n = 4 and not rel_ok""",
    "p2_sound": _P2 + "select line_no, w[1] query_id, w[2] iter, w[3] doc_id, cast(w[4] as int) relevance from v where quoted_well and n = 4 and doc_ok and rel_ok",
    "p3_found": f"""{_RECORDS}, {_META}, {_list_of('topics', 'r', 't')}, {_list_of('narratives', 't', 'n')}, {_list_of('points', 'n', 'p')}, {_list_of('history', 'm', 'h', 'meta')}, {_list_of('changes', 'h', 'c')}
select 'topic_records' tab_name, row_no, node_path from (select row_no, node_path from t union all select row_no, node_path from n union all select row_no, node_path from p union all select row_no, node_path from h union all select row_no, node_path from c)
union all select 'topics', row_no, 'topics/' || ordinal from ({_TYPED})""",
    "p3_topic_rows": _TYPED,
    "p3_topics": f"""{_RECORDS}, {_list_of('topics', 'r', 't')}
select {_PLACE}, o->>'$.lang' lang, o->>'$.topic_title' topic_title, o->>'$.topic_description' topic_description from t
union all select 'topics', row_no, topic_id, '', 'topics/' || ordinal, ordinal, lang, topic_title, topic_description from ({_TYPED})""",
    "p3_narratives": f"""{_RECORDS}, {_list_of('topics', 'r', 't')}, {_list_of('narratives', 't', 'n')} select {_PLACE}, o->>'$.kind' kind from n""",
    "p3_points": f"""{_RECORDS}, {_list_of('topics', 'r', 't')}, {_list_of('narratives', 't', 'n')}, {_list_of('points', 'n', 'p')}
select {_PLACE}, cast(o->>'$.point_no' as bigint) point_no, o->>'$.text' "text" from p""",
    "p3_history": f"""{_RECORDS}, {_META}, {_list_of('history', 'm', 'h', 'meta')},
b as (select *, {_opened("json_extract(o, '$.by')")} by_ from h)
select {_PLACE}, by_->>'$.role' "role", cast(by_->>'$.desk' as bigint) desk from b""",
    "p3_changes": f"""{_RECORDS}, {_META}, {_list_of('history', 'm', 'h', 'meta')}, {_list_of('changes', 'h', 'c')} select {_PLACE}, o->>'$.field' field, o->>'$.old' "old" from c""",
    "p5_found": _P5 + "select ref_field, judged_month, qrel_id from o",
    "p5_report": _P5 + "select ref_field, judged_month, reason, count(*) n from o group by all",
}
