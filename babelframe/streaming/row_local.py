"""Row-local transforms on streams: they hold no state, so append mode needs neither watermark nor store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.codeswitch import switched_in_row
from ..operators.passages import LENGTH, OVERLAP, passages
from ..sources.files import json_documents


def json_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """(doc_id, text) of JSON-lines files as they arrive."""
    return json_documents(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def passage_stream(docs: DataFrame, length: int = LENGTH, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, k, passage) of a stream of documents; dense numbers need a batch."""
    return passages(docs, length, overlap)


def switched_stream(rows: DataFrame, table: dict[str, list[str]], probability: float = 0.5, seed: int = 13, row_key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stream with its text code-switched by a small lexicon."""
    return rows.withColumn(text, switched_in_row(text, table, probability, seed, row_key))


def append(df: DataFrame, path: str, checkpoint: str):
    """Starts writing the stream as Parquet, once over what is there."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
