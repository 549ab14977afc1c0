"""Topics, queries and their judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, topic_number
from .ordering import last_wins

# First and last topic number of each year, for topics without a year of their own and for ranking files.
TOPIC_YEARS = {2000: (0, 40), 2001: (41, 90), 2002: (91, 140), 2003: (141, 200)}
RANKING_YEARS = {2001: (0, 90), 2002: (91, 140), 2003: (141, 200)}


def topics_by_language(topics: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """(topic_id, lang, title, description, first_row): one row per topic and language, the last delivered wins, first_row its first place.

    Null elements and null languages are left out; a null title or description is empty.
    """
    e = topics.select("row_no", "topic_id", F.posexplode("topics").alias("at", "t")).where("t is not null and t.lang is not null and topic_id is not null")
    rows = e.select("row_no", "at", "topic_id", F.col("t.lang").alias("lang"), F.coalesce(strip(F.col("t.topic_title")), F.lit("")).alias("title"), F.coalesce(strip(F.col("t.topic_description")), F.lit("")).alias("description"))
    if languages is not None:
        rows = rows.where(F.col("lang").isin(languages))
    last = F.max_by(F.struct("title", "description"), F.struct("row_no", "at")).alias("last")
    return rows.groupBy("topic_id", "lang").agg(last, F.min("row_no").alias("first_row")).select("topic_id", "lang", "last.title", "last.description", "first_row")


def views(queries: DataFrame, title: str = "title", description: str = "description", with_description: bool = True) -> DataFrame:
    """The queries with title, description and both joined by a blank; without description, that is empty."""
    d = F.coalesce(F.col(description), F.lit("")) if with_description else F.lit("")
    t = F.coalesce(F.col(title), F.lit(""))
    return queries.withColumns({title: t, description: d, "concat": F.concat(t, F.lit(" "), d)})


def judged_ids(judgments: DataFrame, keys: list[str]) -> DataFrame:
    """Different keys with any judgment other than the text '0' ('00' and '-1' count as judged)."""
    return judgments.where("relevance <> '0'").select(*keys).where(" and ".join(f"{k} is not null" for k in keys)).distinct()


def judged_queries(queries: DataFrame, judged: DataFrame) -> DataFrame:
    """Queries (topic_id, lang, ...) judged in their own language; `judged` has (lang, query_id)."""
    return queries.join(judged.select("lang", F.col("query_id").alias("topic_id")).distinct(), ["lang", "topic_id"], "left_semi")


def english_for_targets(queries: DataFrame, judged: DataFrame, english: str = "eng") -> DataFrame:
    """English queries for each language in which they are judged: (target_lang, topic_id, ...)."""
    own = queries.where(F.col("lang") == english).drop("lang")
    return own.join(judged.where(F.col("lang") != english).select(F.col("lang").alias("target_lang"), F.col("query_id").alias("topic_id")).distinct(), "topic_id")


def positives(qrels: DataFrame, negatives: bool = False) -> DataFrame:
    """Judgments with relevance, as a number, other than 0 (or equal to 0), the number as `rel`; unreadable relevance is neither."""
    rel = F.col("relevance").try_cast("int")
    return qrels.withColumn("rel", rel).where(rel == 0 if negatives else rel != 0)


def aggregated_judgments(qrels: DataFrame, prefix: str | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """Different (qid, doc_id) of positive judgments over all years, qid being the number of the query id.

    With a range, a number outside is an error when its row is read. Ids without a number are left out; `prefix` keeps only documents
    whose id begins so, a filter that reaches the scan.
    """
    rows = positives(qrels).where("doc_id is not null")
    if prefix is not None:
        rows = rows.where(F.col("doc_id").startswith(prefix))
    qid = topic_number(F.col("query_id"))
    pairs = rows.select(qid.alias("qid"), "doc_id").where("qid is not null").distinct()
    if low is not None and high is not None:
        ok = F.when(F.col("qid").between(low, high), F.col("qid")).otherwise(F.raise_error(F.concat(F.lit("topic number out of range: "), F.col("qid").cast("string"))).cast("int"))
        pairs = pairs.withColumn("qid", ok)
    return pairs


def kept_judgments(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """Aggregated judgments (qid, doc_id) of the topic numbers that some kept query (qid) has."""
    return pairs.join(kept.select("qid").distinct(), "qid", "left_semi")


def aggregated_queries(queries: DataFrame, judged: DataFrame) -> DataFrame:
    """(lang, qid, title, description): for each language and topic number the queries of the latest year, if `judged` has the number."""
    rows = queries.select("lang", topic_number(F.col("query_id")).alias("qid"), "coll_year", F.coalesce("titles", F.lit("")).alias("title"), F.coalesce("descs", F.lit("")).alias("description")).where("qid is not null and lang is not null")
    last = last_wins(rows, ["lang", "qid"], ["coll_year"], ["title", "description"])
    return last.join(judged.select("qid").distinct(), "qid", "left_semi").select("lang", "qid", "title", "description")


def in_year(number: Column, year: int, years: dict[int, tuple[int, int]] = TOPIC_YEARS) -> Column:
    """Whether a topic number belongs to the year; a year without a range has all from 0."""
    low, high = years.get(year, (0, None))
    return number >= low if high is None else number.between(low, high)
