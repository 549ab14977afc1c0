"""Documents cut into overlapping passages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .ordering import numbered

#: Passage length and overlap in tokens of the shipped presets.
LENGTH, OVERLAP = 180, 90


def _starts(n: Column, length: int, overlap: int) -> Column:
    if overlap >= length:
        raise ValueError(f"overlap {overlap} must be below the passage length {length}")
    return F.when(n <= overlap, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(length - overlap)))


def passages(docs: DataFrame, length: int = LENGTH, overlap: int = OVERLAP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, k, passage): windows of `length` white-space tokens, each starting length - overlap after the last.

    A text of at most `overlap` tokens is one passage, a blank one an empty passage; null texts give none. Windows that lie wholly in the one
    before are kept. Narrow: the windows are made inside the row, in size linear in the text.
    """
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("w"))
    cut = F.transform(_starts(F.size("w"), length, overlap), lambda s: F.array_join(F.slice("w", s + 1, length), " "))
    return rows.select("doc_id", F.posexplode(cut).alias("k", "passage"))


def passage_counts(docs: DataFrame, length: int = LENGTH, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_passages) without making the passages."""
    n = F.size(tokens(F.col("text")))
    count = F.when(n <= overlap, 1).otherwise(F.ceil(n / F.lit(length - overlap)))
    return docs.where("text is not null").select("doc_id", count.cast("bigint").alias("n_passages"))


def regex_offsets(text: str) -> list[tuple[int, int]]:
    """Start and end of each run of characters that are no white space."""
    return [m.span() for m in re.finditer(r"\S+", text)]


def subword_offsets(path: str) -> Callable[[], Callable[[str], list[tuple[int, int]]]]:
    """Offsets of a public subword tokenizer out of its JSON file, without special tokens; for offset_passages."""

    def make() -> Callable[[str], list[tuple[int, int]]]:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        return lambda text: own.encode(text, add_special_tokens=False).offsets

    return make


def offset_passages(docs: DataFrame, tokenizer: Callable[[], Callable[[str], list[tuple[int, int]]]] = lambda: regex_offsets, length: int = LENGTH, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, k, passage) cut from the original text by token offsets, so what stands between tokens stays as it is.

    `tokenizer` makes, once per task, a function from text to (start, end) pairs. Text of at most `overlap` tokens stays whole.
    """
    _starts(F.lit(1), length, overlap)

    @F.pandas_udf("array<struct<b:int,e:int>>")
    def spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        offsets = tokenizer()
        for part in texts:
            out = []
            for t in part:
                pairs = offsets(t)
                n = len(pairs)
                out.append([{"b": 0, "e": len(t)}] if n <= overlap else [{"b": pairs[s][0], "e": pairs[min(s + length, n) - 1][1]} for s in range(0, n, length - overlap)])
            yield pd.Series(out)

    cut = docs.where("text is not null").select("doc_id", "text", spans("text").alias("at"))
    pieces = F.transform("at", lambda x: F.substring(F.col("text"), x["b"] + 1, x["e"] - x["b"]))
    return cut.select("doc_id", F.posexplode(pieces).alias("k", "passage"))


def passage_numbers(counts: DataFrame) -> DataFrame:
    """(doc_id, first_idx) of (doc_id, n_passages): the dense number of each document's first passage, in the order of doc_id, which is unique."""
    return numbered(counts.select("doc_id", "n_passages"), ["doc_id"], "first_idx", weight="n_passages").select("doc_id", "first_idx")


def passage_mapping(counts: DataFrame) -> DataFrame:
    """(passage_idx, original_id) out of (doc_id, n_passages), without making the passages."""
    first = numbered(counts.select("doc_id", "n_passages"), ["doc_id"], "first_idx", weight="n_passages")
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_passages") - 1)).alias("k")
    return first.where("n_passages > 0").select("doc_id", "first_idx", k).select((F.col("first_idx") + F.col("k")).alias("passage_idx"), F.concat_ws("_", "doc_id", "k").alias("original_id"))


def numbered_passages(cut: DataFrame) -> DataFrame:
    """(passage_idx, original_id, doc_id, k, passage): dense numbers in the order of (doc_id, k); original_id is doc_id_k. doc_id must be unique.

    Only documents are put in order; passages meet their document's first number by a join.
    """
    counts = cut.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_passages"))
    own = (F.col("first_idx") + F.col("k")).alias("passage_idx")
    return cut.join(passage_numbers(counts), "doc_id").select(own, F.concat_ws("_", "doc_id", "k").alias("original_id"), "doc_id", "k", "passage")
