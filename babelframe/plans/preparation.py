"""Runs that prepare a campaign's judgments, queries and documents for several languages and years, and their shipped presets."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordering, passages, topics
from ..sources import campaigns, sinks
from ..sources.catalog import Catalog

VIEWS = ("title", "description", "concat")


@dataclass(frozen=True)
class Preset:
    """Languages and years of a pipeline, and how its documents are cut into passages."""

    document_languages: tuple[str, ...]
    document_years: tuple[str, ...] = ()
    judgment_languages: tuple[str, ...] = ()
    judgment_years: tuple[str, ...] = ()
    query_languages: tuple[str, ...] = ()
    query_years: tuple[str, ...] = ()
    length: int = passages.LENGTH
    overlap: int = passages.OVERLAP
    tokenizer: str = ""


# The presets of the shipped pipelines.
PRESETS = {
    "newswire": Preset(("en",), ("2003",), ("en",), campaigns.YEARS, ("de", "fr", "fi", "so", "sw", "en"), campaigns.YEARS, tokenizer="bert-base-multilingual-uncased"),
    "web": Preset(("fas", "rus", "zho"), tokenizer="xlm-roberta-large"),
}


def judgments_of(spark: SparkSession, root: str, languages: list[str], years: list[str]) -> DataFrame:
    """(lang, year, qid, doc_id, rel): positive judgments of each registered language and year as one frame."""
    got = spark.createDataFrame([], "lang string, year string, qid int, doc_id string, rel int")
    for lang in campaigns.registered(languages):
        got = got.unionByName(campaigns.judgments(spark, root, lang, years))
    return got


def queries_of(spark: SparkSession, root: str, languages: list[str], years: list[str], with_description: bool = True, low_resource_root: str | None = None) -> DataFrame:
    """(lang, year, qid, title, description, concat): queries of each registered language and year as one frame."""
    got = spark.createDataFrame([], "lang string, year string, qid int, title string, description string")
    for lang in campaigns.registered(languages):
        got = got.unionByName(campaigns.queries(spark, root, lang, years, with_description=with_description, low_resource_root=low_resource_root))
    return topics.views(got, with_description=with_description)


def aggregated(judged: DataFrame, queries: DataFrame, languages: list[str], prefix: str = "LA", low: int = 1, high: int = 200) -> tuple[DataFrame, DataFrame]:
    """Queries over all years (lang, qid, title, description, concat) that some judged document with the prefix has, and the judgments kept (qid, doc_id).

    Of a topic number the latest year's query counts. Judgments are kept of the numbers that the last of the languages has. A topic number
    outside low to high is an error when its row is read.
    """
    ok = F.when(F.col("qid").between(low, high), F.col("qid")).otherwise(F.raise_error(F.concat(F.lit("topic number out of range: "), F.col("qid").cast("string"))).cast("int"))
    pairs = judged.where("lang = 'en' and rel <> 0").withColumn("qid", ok).where(F.col("doc_id").startswith(prefix)).select("qid", "doc_id").distinct()
    last = ordering.last_wins(queries.withColumn("qid", ok), ["lang", "qid"], ["year"], ["title", "description", "concat"])
    kept = last.join(pairs.select("qid").distinct(), "qid", "left_semi").select("lang", "qid", *VIEWS)
    return kept, topics.kept_judgments(pairs, kept.where(F.col("lang") == languages[-1]))


def write_judgments(judged: DataFrame, out: str, skip_finished: bool = True) -> None:
    """TREC lines of each language and year under out/qrels, in the order of topic number and document."""
    for lang, year in _pairs(judged):
        own = judged.where((F.col("lang") == lang) & (F.col("year") == year))
        _write(own.select("qid", "doc_id", sinks.trec_line(None).alias("value")), f"{out}/qrels/{sinks.name_of(lang, year, 'qrel')}", ["qid", "doc_id"], skip_finished)


def write_queries(queries: DataFrame, out: str, skip_finished: bool = True) -> None:
    """Each view of the queries of each language and year under out/queries, in the order of topic number."""
    for lang, year in _pairs(queries):
        own = queries.where((F.col("lang") == lang) & (F.col("year") == year))
        for view in VIEWS:
            _write(own.select("qid", sinks.tsv_line("qid", view).alias("value")), f"{out}/queries/{sinks.name_of(lang, year, 'queries_' + view)}", ["qid"], skip_finished)


def write_aggregated(kept: DataFrame, pairs: DataFrame, out: str, skip_finished: bool = True) -> None:
    write_queries(kept.withColumn("year", F.lit("2000-2003")), out, skip_finished)
    _write(pairs.select("qid", "doc_id", sinks.trec_line(None).alias("value")), f"{out}/qrels/{sinks.name_of('en', '2000-2003', 'qrels')}", ["qid", "doc_id"], skip_finished)


def write_documents(spark: SparkSession, catalog: Catalog, languages: list[str], years: list[str], out: str, skip_finished: bool = True) -> None:
    """Documents of each language and year that has a collection under out/docs; others are left out with a warning."""
    for lang in campaigns.registered(languages):
        for year in years:
            if (lang, year) not in catalog.corpora:
                logging.warning("no collection of %s in %s, skipping", lang, year)
                continue
            _write(sinks.tsv_lines(catalog.documents(spark, lang, year), "doc_id", "text"), f"{out}/docs/{sinks.name_of(lang, year, 'docs')}", None, skip_finished)


def _pairs(df: DataFrame) -> list[tuple[str, str]]:
    """Languages and years, which are few by the lists they come from."""
    return sorted((r["lang"], r["year"]) for r in df.select("lang", "year").distinct().collect())


def _write(lines: DataFrame, path: str, order: list[str] | None, skip_finished: bool) -> None:
    done = sinks.write_lines(lines, path, order, skip_finished)
    logging.info("%s %s", "wrote" if done else "kept", path)
