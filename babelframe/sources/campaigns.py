"""Judgments, topics and rankings of evaluation campaigns by language and year, out of a folder of their files."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.languages import LANGUAGES
from ..operators.topics import RANKING_YEARS, in_year
from . import files, markup
from .sinks import path_exists

# Years of the campaigns, names of judgment and topic files that follow no rule, letters of the topic files of 2000, and files
# of topics of languages with few resources.
YEARS = ("2000", "2001", "2002", "2003")
JUDGMENT_FILES = {("en", "2000"): "biling_qrels", ("en", "2001"): "qrels_bilingual"}
TOPIC_FILES = {("fi", "2002"): "Top-fi50-02.txt"}
TOPIC_LETTERS = {"en": "E", "fr": "F", "fi": "FI", "de": "G", "it": "I", "sw": "SW", "es": "SP"}
LOW_RESOURCE = {
    "sw": "clef-en-2000-2003-wo-narrative-Day-2_SWAHILI.txt",
    "so": "clef-en-2000-2003-wo-narrative-Day-2_SOMALI.txt",
    "kg": "clef-en-2000-2003_KYRGYZ.txt",
    "tr": "clef-en-2000-2003_TURKISH.txt",
    "ug": "clef-en-2000-2003_UYGHUR.txt",
}
_NAMES = {x: row[0] for row in LANGUAGES for x in row} | {"kyrgyz": "kg", "uyghur": "ug", "kg": "kg", "ug": "ug"}


def code(language: str) -> str:
    """Two-letter code of a registered language, given by code or name; ValueError for others."""
    try:
        return _NAMES[language.lower()]
    except KeyError:
        raise ValueError(f"language {language!r} is not registered") from None


def registered(languages: list[str]) -> list[str]:
    """Codes of the registered languages of a list; others are left out with a warning."""
    found = []
    for x in languages:
        if x.lower() in _NAMES:
            found.append(code(x))
        else:
            logging.warning("language %s is not registered, skipping", x)
    return found


def _years(years: str | list[str]) -> list[str]:
    given = [years] if isinstance(years, str) else list(years)
    if wrong := [y for y in given if y not in YEARS]:
        raise ValueError(f"no campaign in {wrong}")
    return given


def judgment_file(spark: SparkSession, root: str, language: str, year: str) -> str | None:
    """Path of a year's judgments of a language: by its own name, else by the language's name, else by its code; None if none of them is there."""
    short = code(language)
    full = next((row[2] for row in LANGUAGES if row[0] == short), short)
    for name in (JUDGMENT_FILES.get((short, year), f"qrels_{full}"), f"qrels_{short.upper()}"):
        if path_exists(spark, path := f"{root}/{year}rels/{name}"):
            return path
    return None


def judgments(spark: SparkSession, root: str, language: str, years: str | list[str], negatives: bool = False) -> DataFrame:
    """(lang, year, qid, doc_id, rel) of relevance other than 0 (or equal to 0), every row; years without a file have none.

    Lines are cut at single blanks; relevance is the last field, and one that is no number is an error when its row is read.
    """
    got = spark.createDataFrame([], "lang string, year string, qid int, doc_id string, rel int")
    for year in _years(years):
        path = judgment_file(spark, root, language, year)
        if path is None:
            logging.warning("no judgments of %s in %s", language, year)
            continue
        rows = files.spaced_judgments(files.lines(spark, path))
        rel = F.coalesce("rel", F.raise_error(F.concat(F.lit("relevance is no number in the line of query "), F.coalesce("query_id", F.lit("?")))).cast("int"))
        rows = rows.select(F.lit(code(language)).alias("lang"), F.lit(year).alias("year"), F.trim("query_id").cast("int").alias("qid"), F.trim("doc_id").alias("doc_id"), rel.alias("rel"))
        got = got.unionByName(rows.where("rel = 0" if negatives else "rel <> 0"))
    return got


def queries(spark: SparkSession, root: str, language: str, years: str | list[str], limit: int | None = None, with_description: bool = True, low_resource_root: str | None = None) -> DataFrame:
    """(lang, year, qid, title, description) of the topics of a language; a missing file is an error.

    Languages with few resources have one file of blocks for all years, cut by topic number. The files of 2000 need no end tags. Of the other
    files the first limit + 1 topics are read, as users of the limit expect.
    """
    short = code(language)
    got = spark.createDataFrame([], "lang string, year string, qid int, title string, description string")
    for year in _years(years):
        if short in LOW_RESOURCE:
            own = markup.block_topics(markup.read_whole(spark, f"{low_resource_root or root}/{LOW_RESOURCE[short]}", "UTF-8")).where(in_year(F.col("qid"), int(year)))
        elif year == "2000":
            if short not in TOPIC_LETTERS:
                raise ValueError(f"no topics of {language} in 2000")
            letters = TOPIC_LETTERS[short]
            own = markup.topics(markup.open_topics(markup.read_whole(spark, f"{root}/topics2000/TOP-{letters}.txt")), letters, with_description)
        else:
            name = TOPIC_FILES.get((short, year), f"Top-{short}{year[-2:]}.txt")
            parts = markup.fragments(markup.read_whole(spark, f"{root}/topics{year}/{name}", "UTF-8" if short == "ru" else "ISO-8859-1"), "top")
            own = markup.topics(parts if limit is None else parts.where(F.col("at") <= limit), short, with_description)
        got = got.unionByName(own.select(F.lit(short).alias("lang"), F.lit(year).alias("year"), "qid", "title", "description"))
    return got


def rankings(spark: SparkSession, folder: str, year: str | None = None) -> DataFrame:
    """(qid, rank, doc_id, score) of a folder of ranking files, those of a year's topic numbers; any from 0 without a year."""
    rows = files.rankings(files.lines(spark, folder))
    return rows.where(F.col("qid") >= 0) if year is None else rows.where(in_year(F.col("qid"), int(year), RANKING_YEARS))
