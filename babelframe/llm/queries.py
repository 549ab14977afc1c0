"""Registered queries of the subpackage."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..session import stored, table
from . import garbled, leaks, lookalikes, mixing, spans

#: The public vocabulary that counts tokens; the folder is where the public tokenizers lie.
TOKENIZER = mixing.Tokenizer(os.environ.get("BABELFRAME_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_multi_50k.tiktoken")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.texts_of(table(spark, d, "load_documents"), table(spark, d, "topics"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.same_looking(_texts(spark, d))


def p1_consistent(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.consistent(_texts(spark, d)).select("field_name", "key", "text")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return garbled.records_of(table(spark, d, "load_documents"), table(spark, d, "process_queries"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled(_records(spark, d)).select("field_name", "rec_key").distinct()


def p4_mapping(spark: SparkSession, d: str) -> DataFrame:
    records = stored(_records(spark, d))
    models = garbled.language_models(records)
    return garbled.cipher_tables(stored(garbled.garbled(records, models)), models)


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    records = stored(_records(spark, d))
    models = garbled.language_models(records)
    found = stored(garbled.garbled(records, models))
    return garbled.restored(found, stored(garbled.cipher_tables(found, models)), models)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_report(p6_found(spark, d), table(spark, d, "eval_items"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    counts = stored(mixing.token_counts(table(spark, d, "documents"), TOKENIZER))
    plan, rows = mixing.mixture_plan(counts, table(spark, d, "mix_targets"))
    return plan, mixing.mixture(plan, rows)


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"))


def p8_amounts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return spans.shared_amount(docs, spans.shared_spans(docs))


QUERIES = {f.__name__: f for f in (p1_found, p1_consistent, p4_found, p4_mapping, p4_restored, p6_found, p6_report, p7_mixture, p7_shares, p8_found, p8_amounts)}
ORACLE: dict[str, str] = {
    "p6_found": r"""
with d as (select doc_id, regexp_extract_all(lower("text"), '[\p{L}\p{N}]+') w from documents where "text" is not null),
i as (select item_id, regexp_extract_all(lower("text"), '[\p{L}\p{N}]+') w from eval_items where "text" is not null),
r as (select distinct item_id, n, array_to_string(w[k : k + n - 1], ' ') run from (select item_id, w, least(len(w), 12) n, unnest(range(1, len(w) - least(len(w), 12) + 2)) k from i where len(w) > 0)),
t as (select doc_id, n, array_to_string(w[k : k + n - 1], ' ') run from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) k from d, (select distinct n from r) where len(w) >= n))
select distinct doc_id, item_id from t join r using (n, run)""",
    "p8_found": """
with w as (select doc_id, j - 1 a, md5(substr("text", j, 260)) h from (select doc_id, "text", unnest(range(1, length("text") - 258)) j from documents where length("text") >= 260)),
s as (select h from w group by h having min(doc_id) < max(doc_id)),
m as (select doc_id, a, case when a <= lag(a) over (partition by doc_id order by a) + 260 then 0 else 1 end f from w where h in (select h from s)),
g as (select doc_id, a, sum(f) over (partition by doc_id order by a) g from m)
select doc_id, min(a) start_at, max(a) + 260 end_at from g group by doc_id, g""",
}
ORACLE["p6_report"] = f"""
select e.item_id, e.split_name, count(f.doc_id) n_documents from eval_items e left join ({ORACLE["p6_found"]}) f on f.item_id = e.item_id group by 1, 2"""
ORACLE["p8_amounts"] = f"""
select doc_id, cast(n as bigint) n_chars, cast(s as bigint) shared_chars, case when n > 0 then round(s::double / n, 6) else 0.0::double end shared_share
from (select d.doc_id, coalesce(length(any_value(d."text")), 0) n, coalesce(sum(f.end_at - f.start_at), 0) s from documents d left join ({ORACLE["p8_found"]}) f on f.doc_id = d.doc_id group by d.doc_id)"""
