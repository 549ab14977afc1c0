"""Language codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-letter and three-letter codes and English names of the languages of the collections.
LANGUAGES = (
    ("de", "deu", "german"),
    ("en", "eng", "english"),
    ("es", "spa", "spanish"),
    ("fa", "fas", "farsi"),
    ("fi", "fin", "finnish"),
    ("fr", "fra", "french"),
    ("it", "ita", "italian"),
    ("nl", "nld", "dutch"),
    ("ru", "rus", "russian"),
    ("so", "som", "somali"),
    ("sv", "swe", "swedish"),
    ("sw", "swa", "swahili"),
    ("tr", "tur", "turkish"),
    ("zh", "zho", "chinese"),
)


def _lookup(code: Column, pairs: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.coalesce(table[F.lower(code)], F.lower(code))


def iso3(code: Column) -> Column:
    """Three-letter code of a two-letter code or name; other codes stay, in lower case; null stays null."""
    return _lookup(code, {x: row[1] for row in LANGUAGES for x in (row[0], row[2])})


def name_of(code: Column) -> Column:
    """English name of a two- or three-letter code; other codes stay, in lower case; null stays null."""
    return _lookup(code, {x: row[2] for row in LANGUAGES for x in row[:2]})
