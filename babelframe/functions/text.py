"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separators that count as such in most text tools.
SPACE = r"[\s\x1c-\x1f]"


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends; null stays null."""
    # only the first of a run of white space is tried, so long runs inside cost no more than others
    return F.regexp_replace(x, rf"(?U)^{SPACE}+|(?<!{SPACE}){SPACE}++$", "")


def clean_text(x: Column) -> Column:
    """Each run of white space as one blank, none at the ends; null stays null, blank text becomes empty."""
    return F.trim(F.regexp_replace(x, rf"(?U){SPACE}+", " "))


def drop_newlines(x: Column) -> Column:
    """Without line breaks, nothing put in their place."""
    return F.regexp_replace(x, r"[\n\r]", "")


def tokens(x: Column) -> Column:
    """Words between white space; an empty array for blank text, null for null."""
    c = clean_text(x)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def word_tokens(x: Column) -> Column:
    """Words (with inner apostrophes and hyphens) and single signs, in order; null for null."""
    return F.regexp_extract_all(x, F.lit(r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]++)*+|[^\s\p{L}\p{N}]"), 0)


def join_tokens(x: Column) -> Column:
    """Tokens as running text: no blank before closing and after opening signs."""
    return F.regexp_replace(F.regexp_replace(F.array_join(x, " "), r" ([.,;:!?)\]}”»%])", "$1"), r"([(\[{“«]) ", "$1")


# Where the Penn Treebank conventions part a text, as pattern and replacement, in order.
TREEBANK = (
    (r'^"|(?<=[ (\[{<])"', " `` "),
    (r"\.\.\.", " ... "),
    (r"[;@#$%&?!\[\](){}<>]|--", " $0 "),
    (r"[:,](?!\d)", " $0 "),
    (r"(?<=[^.])(\.)([\])}>\"']*)\s*$", " $1 $2"),
    (r'"', " '' "),
    (r"(?i)(?<=\w)('s|'m|'d|'ll|'re|'ve|n't)(?!\w)", " $1"),
    (r"(?<=\w)'(?= |$)", " '"),
    (r"(?i)\b(can)(not)\b", "$1 $2"),
    (r"(?i)\b(gon|wan)(na)\b|\b(got)(ta)\b|\b(gim|lem)(me)\b", "$1$3$5 $2$4$6"),
)


def treebank_tokens(x: Column) -> Column:
    """Words and signs by the Penn Treebank conventions (quotes as `` and '', contractions apart); null for null. An approximation by rules."""
    for pattern, new in TREEBANK:
        x = F.regexp_replace(x, pattern, new)
    return tokens(x)


def join_treebank(x: Column) -> Column:
    """Treebank tokens as running text: quotes and contractions joined again, no blank before closing and after opening signs."""
    text = F.regexp_replace(F.regexp_replace(F.array_join(x, " "), "`` ?", '"'), " ?''", '"')
    text = F.regexp_replace(text, r"(?i) ('s|'m|'d|'ll|'re|'ve|n't)(?!\w)", "$1")
    text = F.regexp_replace(F.regexp_replace(text, r" (\.\.\.|[.,;:!?)\]}%]|'(?= |$))", "$1"), r"([(\[{$#]) ", "$1")
    return F.regexp_replace(text, r"(?i)\b(can) (not)\b", "$1$2")


def plain_terms(x: Column) -> Column:
    """The terms of a text with one blank between them; null gives an empty text."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def terms(x: Column) -> Column:
    """Runs of letters and digits in lower case, for indexing; null gives none."""
    plain = plain_terms(x)
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def match_case(replacement: Column, source: Column) -> Column:
    """The replacement in the case of the source: all upper, capitalised (the rest lowered), or as it is."""
    first = F.substring(source, 1, 1)
    upper = (source == F.upper(source)) & (source != F.lower(source))
    capital = (first == F.upper(first)) & (first != F.lower(first))
    return F.when(upper, F.upper(replacement)).when(capital, F.concat(F.upper(F.substring(replacement, 1, 1)), F.lower(F.substring(replacement, 2, 2**31 - 1)))).otherwise(replacement)


def document_hash(title: Column, text: Column) -> Column:
    """MD5 of the stripped title followed by the stripped text; null parts count as empty."""
    return F.md5(F.concat(F.coalesce(strip(title), F.lit("")), F.coalesce(strip(text), F.lit(""))))


def topic_number(x: Column) -> Column:
    """The number after the first character of a topic id; null where there is none."""
    return F.substring(x, 2, 2**31 - 1).try_cast("int")


def after_last(x: Column, marker: str) -> Column:
    """What follows the last occurrence of the marker, or all of x."""
    return F.substring_index(x, marker, -1)


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys only, whatever the order or partitioning of rows."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *keys))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def choice(n: Column, seed: int, *keys: Column) -> Column:
    """An index below n, drawn independently of uniform() for the same keys."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *keys))
    return F.pmod(F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint"), n.cast("bigint")).cast("int")


def sentences(x: Column) -> Column:
    """Sentences of the cleaned text: cut after . ! ? where white space follows; no empty ones."""
    return F.filter(F.split(clean_text(x), r"(?<=[.!?])\s+"), lambda s: s != "")
