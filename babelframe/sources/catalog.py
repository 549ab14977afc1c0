"""Which corpora make the collection of a language and year."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import campaigns, markup
from .files import rerank_corpus


@dataclass(frozen=True)
class Corpus:
    """Folder below the root, extraction rule and encoding."""

    folder: str
    rule: str
    encoding: str = "ISO-8859-1"


@dataclass(frozen=True)
class Collection:
    """Documents, queries and judgments of one language and year."""

    documents: DataFrame
    queries: DataFrame
    judgments: DataFrame


# Language, folder below the document root, extraction rule, encoding and years of the newswire corpora.
NEWSWIRE = (
    ("nl", "Dutch_data/algemeen_dagblad", "dutch", "ISO-8859-1", ("2001", "2002", "2003")),
    ("nl", "Dutch_data/nrc_handelsblad", "dutch", "ISO-8859-1", ("2001", "2002", "2003")),
    ("it", "Italian_data/la_stampa", "italian_lastampa", "ISO-8859-1", ("2001", "2002", "2003")),
    ("it", "Italian_data/sda_italian", "italian_sda9495", "ISO-8859-1", ("2001", "2002", "2003")),
    ("it", "Italian_data/agz95", "italian_sda9495", "ISO-8859-1", ("2003",)),
    ("fi", "Finnish_data/aamu", "finnish_aamulehti", "ISO-8859-1", ("2002", "2003")),
    ("en", "English_data/LATimes94", "english_latimes", "ISO-8859-1", ("2000", "2001", "2002", "2003")),
    ("de", "German_data/der_spiegel", "german_derspiegel", "ISO-8859-1", ("2002", "2003")),
    ("de", "German_data/fr_rundschau", "german_frrundschau", "ISO-8859-1", ("2002", "2003")),
    ("de", "German_data/sda_german", "german_sda", "ISO-8859-1", ("2002", "2003")),
    ("de", "German_data/sda95", "german_sda", "ISO-8859-1", ("2002", "2003")),
    ("ru", "Russian_data/xml", "russian", "UTF-8", ("2003",)),
)


def newswire_corpora() -> dict[tuple[str, str], list[Corpus]]:
    """The newswire corpora by language and year; Finnish has a year without any."""
    found: dict[tuple[str, str], list[Corpus]] = {("fi", "2001"): []}
    for lang, folder, rule, encoding, years in NEWSWIRE:
        for year in years:
            found.setdefault((lang, year), []).append(Corpus(folder, rule, encoding))
    return found


class Catalog:
    """Corpora by language and year, the newswire ones unless others are given; nothing is read before it is asked for."""

    def __init__(self, root: str, corpora: dict[tuple[str, str], list[Corpus]] | None = None) -> None:
        self.root, self.corpora = root, newswire_corpora() if corpora is None else corpora

    def documents(self, spark: SparkSession, lang: str, years: str | list[str], body_only: bool = False, only_ids: DataFrame | None = None, limit: int | None = None) -> DataFrame:
        """(doc_id, text) of all corpora of the language in the years; an unknown pair is an error, a pair without corpora is empty.

        With `limit`, of each file the first `limit` documents count, and of the files of a corpus those after which it is reached are not read.
        """
        got = spark.createDataFrame([], "doc_id string, text string")
        for year in [years] if isinstance(years, str) else years:
            if (lang, year) not in self.corpora:
                raise ValueError(f"no collection of {lang} in {year}; there are {sorted(self.corpora)}")
            for c in self.corpora[lang, year]:
                files = markup.read_whole(spark, f"{self.root}/{c.folder}", c.encoding)
                got = got.unionByName(markup.documents(markup.fragments(files, "DOC"), c.rule, body_only, only_ids, limit))
        return got

    def collection(self, spark: SparkSession, lang: str, year: str, query_language: str, topics_root: str, judgments_root: str, rankings: str | None = None, top: int = -1) -> Collection:
        """Documents of a language and year with the topics in a query language and the judgments of the documents' language, read from
        their folders; with a folder of rankings and top >= 0, only documents among the first `top` of any query of the year."""
        only = None if rankings is None or top < 0 else rerank_corpus(campaigns.rankings(spark, rankings, year), top)
        topics = campaigns.queries(spark, topics_root, query_language, year)
        return Collection(self.documents(spark, lang, year, only_ids=only), topics, campaigns.judgments(spark, judgments_root, lang, year))
