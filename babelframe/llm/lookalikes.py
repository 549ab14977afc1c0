"""Texts that look the same but are stored differently, as Spark jobs over the folding and repair of glyphs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import glyphs

_PIECES = pa.list_(pa.struct([("s", pa.string()), ("t", pa.string())]))


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _folded(keep_text: bool):
    """Rows of texts (raw and folded hash, or the pieces of a text with doubtful words) and, apart, the different words of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, done, pieces, kept = [], [], [], []
            tokens: set[str] = set()
            forms = [glyphs.fold(t) for t in batch.column(2).to_pylist()]
            batch = batch.filter(pa.array([bool(f.strip()) for f in forms]))
            forms = [f for f in forms if f.strip()]
            for text, form in zip(batch.column(2).to_pylist(), forms, strict=True):
                tokens.update(form.split())
                parts = glyphs.doubtful_words(form)
                whole = len(parts) == 1 and parts[0][1] is None
                raw.append(_digest(text))
                done.append(_digest(form) if whole else None)
                pieces.append(None if whole else [{"s": s, "t": t} for s, t in parts])
                kept.append(form if whole and keep_text else None)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary()), pa.array(done, pa.binary()), pa.array(pieces, _PIECES), pa.array(kept, pa.string()), pa.nulls(n, pa.string())], _NAMES)
            words = sorted({w for t in tokens for w in glyphs.LETTERS.findall(t)})
            if words:
                m = len(words)
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.string()), pa.nulls(m, pa.string()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.nulls(m, _PIECES), pa.nulls(m, pa.string()), pa.array(words)], _NAMES)

    return run


_NAMES = ["field_name", "key", "raw", "done", "pieces", "text", "word"]
_COLUMNS = "field_name string, key string, raw binary, done binary, pieces array<struct<s:string,t:string>>, text string, word string"


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(3).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(map(_digest, texts), pa.binary()), batch.column(3)], ["field_name", "key", "raw", "done", "text"])


def consistent(texts: DataFrame, keep_text: bool = True) -> DataFrame:
    """One consistent form of each text: (field_name, key, raw, done, text), raw and done being hashes of the stored text and of its form.

    `texts` has (field_name, key, text); null and blank texts are left out, equal rows come out once. Widths, composed accents, invisible
    characters, blanks, hyphens, joined letters and positional shapes are folded in any text. A word that mixes scripts is repaired towards
    its dominant script (a word of look-alikes only: that of the text) when the result is in the corpus vocabulary; else it stays.
    With keep_text false, text is null but for repaired texts.

    The vocabulary is the words of all folded texts, counted once per batch before the shuffle; doubtful words are joined with it,
    and only texts with doubtful words travel for that.
    """
    rows = texts.select("field_name", F.col("key").cast("string").alias("key"), "text").where("key is not null and text is not null")
    rows = rows.distinct() if keep_text else rows
    folded = stored(rows.mapInArrow(_folded(keep_text), _COLUMNS))
    whole = folded.where("done is not null").select("field_name", "key", "raw", "done", "text")
    doubtful = folded.where("pieces is not null").select("field_name", "key", "raw", "pieces").distinct()
    forms = doubtful.select(F.explode("pieces").alias("p")).where("p.t is not null").select(F.col("p.t").alias("word")).distinct()
    known = folded.where("word is not null").select("word").distinct().join(forms, "word").select("word", F.lit(True).alias("known"))
    placed = doubtful.select("field_name", "key", "raw", F.posexplode("pieces").alias("at", "p")).select("field_name", "key", "raw", "at", "p.s", F.col("p.t").alias("word"))
    placed = placed.join(known, "word", "left")
    piece = F.when(F.col("known"), F.col("word")).otherwise(F.col("s"))
    repaired = placed.groupBy("field_name", "key", "raw").agg(F.array_sort(F.collect_list(F.struct("at", piece.alias("s")))).alias("all")).select("field_name", "key", "raw", F.concat_ws("", F.col("all.s")).alias("text"))
    repaired = repaired.mapInArrow(_hashed, "field_name string, key string, raw binary, done binary, text string")
    return whole.unionByName(repaired)


def same_looking(texts: DataFrame) -> DataFrame:
    """(field_name, key_a, key_b), each pair once, smaller key first: a text of one and a text of the other are stored differently and have one consistent form.

    Null and blank texts (also blank after folding) and byte-equal texts are no case. Copies are grouped by their stored text first, so a
    group of equal texts meets another one once and is expanded only into pairs that are results.
    """
    forms = consistent(texts, keep_text=False).select("field_name", "key", "raw", "done")
    several = forms.groupBy("field_name", "done").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where("a <> b").select("field_name", "done")
    cases = stored(forms.join(several, ["field_name", "done"]).distinct())
    kinds = cases.select("field_name", "done", "raw").distinct()
    a, b = kinds.withColumnRenamed("raw", "raw_a"), kinds.withColumnRenamed("raw", "raw_b")
    pairs = a.join(b, ["field_name", "done"]).where("raw_a < raw_b")
    left = cases.select("field_name", F.col("raw").alias("raw_a"), F.col("key").alias("k"))
    right = cases.select("field_name", F.col("raw").alias("raw_b"), F.col("key").alias("l"))
    both = pairs.join(left, ["field_name", "raw_a"]).join(right, ["field_name", "raw_b"]).where("k <> l")
    return both.select("field_name", F.least("k", "l").alias("key_a"), F.greatest("k", "l").alias("key_b")).distinct()


def texts_of(load_documents: DataFrame, topics: DataFrame) -> DataFrame:
    """All texts by field: documents under doc_id, topic titles under topic_id/lang; a row with a null part of its key is left out."""
    docs = load_documents.select(F.lit("documents").alias("field_name"), F.col("doc_id").alias("key"), F.col("documents").alias("text"))
    titles = topics.select("topic_id", F.explode("topics").alias("t")).select(F.lit("topic_title").alias("field_name"), F.concat("topic_id", F.lit("/"), "t.lang").alias("key"), F.col("t.topic_title").alias("text"))
    return docs.unionByName(titles)
