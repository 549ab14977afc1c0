"""Translation of queries through a backend."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences, strip

#: Texts given to a backend at once.
BATCH = 128


def query_sentences(queries: DataFrame, key: str = "query_id", text: str = "text", repair: Callable[[Column], Column] | None = None) -> DataFrame:
    """(query_id, sent_no, sentence): sentences of each text in order; null and blank texts give none.

    `repair` makes the text right before it is cut, as a column function: for instance a repair of wrong encodings.
    """
    whole = F.col(text) if repair is None else repair(F.col(text))
    return queries.select(F.col(key).alias("query_id"), F.posexplode(sentences(whole)).alias("sent_no", "sentence"))


def word_by_word(table: dict[str, str]) -> Callable[[list[str]], list[str]]:
    """A backend that puts each known word in the other language and leaves the rest."""
    return lambda texts: [" ".join(table.get(w.lower(), w) for w in t.split()) for t in texts]


def translated(rows: DataFrame, backend: Callable[[], Callable[[list[str]], list[str]]], column: str = "sentence", batch: int = BATCH) -> DataFrame:
    """The rows with `translation`, stripped; null stays null. `backend` makes the translator once per task, which gets lists of at most `batch` texts."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        translate = backend()
        for part in parts:
            known = part.dropna()
            out = [y for i in range(0, len(known), batch) for y in translate(known.iloc[i : i + batch].tolist())]
            yield pd.Series(out, index=known.index, dtype=object).reindex(part.index)

    return rows.withColumn("translation", strip(run(column)))


def regrouped(rows: DataFrame, column: str = "translation") -> DataFrame:
    """(query_id, text): the sentences of each query joined in order; a query's sentences are a bounded group."""
    parts = F.array_sort(F.collect_list(F.struct("sent_no", F.col(column).alias("s"))))
    return rows.groupBy("query_id").agg(parts.alias("p")).select("query_id", F.array_join("p.s", " ").alias("text"))
