"""Newswire markup: documents and topics out of tagged text files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text, drop_newlines, strip, topic_number
from .files import limited_over_files


def read_whole(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", pattern: str | None = None) -> DataFrame:
    """(path, text): whole files, plain or gzip, decoded; DTDs and README files are left out. Invalid UTF-8 bytes are dropped."""
    name = F.col("_metadata.file_name")
    raw = spark.read.text(path, wholetext=True, pathGlobFilter=pattern).where(~name.endswith(".dtd") & ~name.startswith("README"))
    if encoding.upper() in ("UTF-8", "UTF8"):
        text = F.replace(F.make_valid_utf8("value"), F.lit("�"), F.lit(""))
    else:
        text = F.decode(F.col("value").cast("binary"), encoding)
    return raw.select(F.col("_metadata.file_path").alias("path"), text.alias("text"))


def fragments(files: DataFrame, tag: str) -> DataFrame:
    """(path, at, fragment): every element `tag` of each file, in any case, in file order."""
    cut = F.regexp_extract_all("text", F.lit(rf"(?is)<{tag}\b.*?</{tag}\s*>"), 0)
    return files.select("path", F.posexplode(cut).alias("at", "fragment"))


@dataclass(frozen=True)
class Extraction:
    """Which elements of a document make its id and text.

    Paths are tag names joined by `/` below the document. `full` has the fields of the text in order, `body` those of the body alone; each is
    a path and whether all matches count or only the first.
    """

    ids: tuple[str, ...]
    body: tuple[str, bool]
    full: tuple[tuple[str, bool], ...] = field(default=())


# The elements that make id, body and text in each corpus; True where all matches count.
EXTRACTIONS = {
    "english_gh": Extraction(("docid",), ("text", True), (("headline", False), ("text", True))),
    "english_latimes": Extraction(("docno", "docid"), ("text/p", True), (("headline/p", True), ("text/p", True))),
    "german_derspiegel": Extraction(("docid",), ("text", True), (("title", True), ("lead", False), ("text", True))),
    "german_frrundschau": Extraction(("docid",), ("text", False), (("title", True), ("text", False))),
    "german_sda": Extraction(("docid",), ("tx", True), (("tx", True), ("ld", False), ("ti", False), ("kw", False))),
    "russian": Extraction(("docid",), ("text", False), (("text", False), ("title", False), ("subject", False))),
    "dutch": Extraction(("docid",), ("body/te/p", True), (("body/le/p", True), ("body/te/p", True), ("body/ti/p", True), ("body/os/p", True))),
    "italian_lastampa": Extraction(("docid",), ("text", True), (("text", True), ("title", True))),
    "italian_sda9495": Extraction(("docid",), ("tx", True), (("ti", True), ("ld", True), ("tx", True))),
    "finnish_aamulehti": Extraction(("docid",), ("text", True), (("text", True),)),
}


class _Leading(HTMLParser):
    """Text before the first child of each element, by path below the fragment's root. A new <p> ends an open one; stray end tags are ignored."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str], bool]] = []
        self.found: dict[str, list[list[str]]] = {}
        self.closed: list[bool] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "izv":
            return
        if tag == "p" and self.open and self.open[-1][0] == "p":
            self.open.pop()
            self.closed.pop()
        if self.closed:
            self.closed[-1] = True
        text: list[str] = []
        self.open.append((tag, text, False))
        self.closed.append(False)
        self.found.setdefault("/".join(t for t, _, _ in self.open[1:]), []).append(text)

    def handle_endtag(self, tag: str) -> None:
        for i in reversed(range(len(self.open))):
            if self.open[i][0] == tag:
                del self.open[i:], self.closed[i:]
                return

    def handle_data(self, data: str) -> None:
        if self.open and not self.closed[-1]:
            self.open[-1][1].append(data)


def extract_fields(fragment: str, rule: Extraction, body_only: bool = False) -> tuple[str | None, str | None]:
    """Id and text of one document; the id is null if no id element has text. Fields are joined by a blank."""
    parser = _Leading()
    parser.feed(fragment)
    parser.close()

    def text(path: str, every: bool) -> str:
        parts = ["".join(x) for x in parser.found.get(path, [])]
        return " ".join(parts) if every else parts[0] if parts else ""

    own = next((t for path in rule.ids if (t := text(path, False).strip())), None)
    return own, text(*rule.body) if body_only else " ".join(text(*f) for f in rule.full)


def documents(parts: DataFrame, corpus: str, body_only: bool = False, only_ids: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(doc_id, text) of fragments by the corpus' rule; rows without id are dropped, full text is cleaned and body text is not.

    With `only_ids` (doc_id), other documents are dropped; an empty frame drops all of them. `limit` is as in limited_over_files.
    """
    rule = EXTRACTIONS[corpus]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["fragment"].notna()]
            found = pd.DataFrame([extract_fields(x, rule, body_only) for x in batch["fragment"]], columns=["doc_id", "text"], dtype=object)
            yield pd.concat([batch[["path", "at"]].reset_index(drop=True), found], axis=1)

    got = parts.select("path", "at", "fragment").mapInPandas(run, "path string, at int, doc_id string, text string").where("doc_id is not null and text is not null")
    if not body_only:
        got = got.withColumn("text", clean_text(F.col("text")))
    if only_ids is not None:
        got = got.join(only_ids.select("doc_id"), "doc_id", "left_semi")
    if limit is not None:
        got = limited_over_files(got, limit)
    return got.select("doc_id", "text")


def open_topics(files: DataFrame) -> DataFrame:
    """(path, at, fragment): what follows each tag <top> up to </top>, the next <top> or the end; for files that leave end tags out."""
    pieces = F.transform(F.split("text", "(?i)<top>"), lambda x: F.regexp_replace(x, r"(?is)</top>.*", ""))
    cut = files.select("path", F.posexplode(F.slice(pieces, 2, 1 << 30)).alias("at", "fragment"))
    return cut.where(F.col("fragment").rlike("(?i)<num>"))


def _element(fragment: str, tag: str) -> Column:
    """Text of a topic's field up to the next tag of a topic. Signs that stand for no tag belong to it; entities are what they stand for."""
    ends = r"</|<(?:num|top|[A-Za-z]{1,2}-(?:title|desc|narr))\b|\z"
    text = F.regexp_extract(fragment, rf"(?is)<{tag}>(.*?)(?={ends})", 1)
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(sign))
    return text


def topics(parts: DataFrame, language: str, with_description: bool = True) -> DataFrame:
    """(qid, title, description) of topic fragments tagged num, {language}-title and {language}-desc.

    Line breaks are deleted, nothing put in their place; qid is the number after the id's first character. Text that runs on over lines
    belongs to its field up to the next tag.
    """
    num = F.regexp_extract("fragment", r"(?is)<num>\s*([^\s<]+)", 1)
    field_of = lambda name: strip(drop_newlines(_element("fragment", f"{language}-{name}")))
    return parts.select(topic_number(num).alias("qid"), field_of("title").alias("title"), (field_of("desc") if with_description else F.lit("")).alias("description"))


def block_topics(files: DataFrame) -> DataFrame:
    """(qid, title, description) of blocks of lines query_id:, title:, description:, parted by blank lines; text after the last marker counts."""
    block = files.select(F.explode(F.split("text", r"\n\s*\n")).alias("b")).where("b rlike 'query_id:'")

    def part(name: str) -> Column:
        return strip(F.regexp_replace(F.regexp_extract("b", rf"(?s){name}:(.*?)(?=\n(?:query_id|title|description):|\z)", 1), r"\s*\n\s*", " "))

    return block.select(topic_number(part("query_id")).alias("qid"), part("title").alias("title"), part("description").alias("description"))
