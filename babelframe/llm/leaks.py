"""Evaluation texts leaking into training text: MinHash containment search in partitions of equal size."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, sliced_join
from ..session import stored
from . import codes as C

#: Words that must come together, and words of a shingle.
LEAST_WORDS, SHINGLE = 12, 5
#: Characters of documents searched at once in a task.
PART_CHARS = 2_000_000
#: Runs of documents with one signature from which on they are spread over several tasks.
HOT_ROWS = 50_000


@cache
def _word_characters() -> np.ndarray:
    """For every code point, whether it is a letter or digit."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


class Words:
    """Words of texts as arrays: text number, start and end in the lower-cased text, and hash."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = [t.lower() for t in texts]
        codes, self.starts = C.code_points(self.texts)
        inside = np.zeros(len(codes) + 2, bool)
        inside[1:-1] = _word_characters()[codes]
        first = inside[1:] & ~inside[:-1]
        last = ~inside[1:] & inside[:-1]
        cut = self.starts[1:-1]
        cut = cut[inside[cut] & inside[cut + 1]]  # words of two texts that touch
        first[cut] = True
        last[cut] = True
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last)
        self.text = np.searchsorted(self.starts, self.start, "right") - 1
        self.hash = self._hashes(codes)

    def _hashes(self, codes: np.ndarray) -> np.ndarray:
        n = len(self.start)
        if not n:
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        own = codes[np.repeat(self.start, size) + place]
        powers = C.RangeHash.powers(C.BASE, int(size.max()))
        sums = np.add.reduceat((own.astype(np.uint64) + np.uint64(1)) * powers[place], np.cumsum(size) - size)
        return C.mixed(sums ^ size.astype(np.uint64))

    def run(self, first: int, n: int) -> list[str]:
        """The n words from number `first`."""
        at = self.starts[self.text[first]]
        text = self.texts[self.text[first]]
        return [text[a - at : b - at] for a, b in zip(self.start[first : first + n], self.end[first : first + n], strict=True)]


def signatures(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of n words within a text: number of its first word, and MinHash signature of the run's set of shingles.

    Two least values under two orders, in one number. Runs of the same words have the same signature.
    """
    width = min(n, SHINGLE)
    count = len(words.hash) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    shingle = np.zeros(len(words.hash) - width + 1, np.uint64)
    for i in range(width):
        shingle = shingle * np.uint64(C.BASE) + words.hash[i : i + len(shingle)]
    shingle = C.mixed(shingle)
    least = [C.window_least(x, n - width + 1) for x in (shingle, C.mixed(shingle ^ np.uint64(C.BASE)))]
    first = np.flatnonzero(words.text[:count] == words.text[n - 1 :])
    return first, (least[0] ^ (least[1] << np.uint64(1)))[first]


def _keys(signature: np.ndarray, n: int) -> np.ndarray:
    """Signatures of runs of n words as keys of the sieve."""
    return signature ^ np.uint64(C.BASE * n % (1 << 64))


def _document_runs(sizes: list[int], sieve: Broadcast):
    """The runs of documents, as long as some item's, whose signature the sieve passes: (id, n, signature, words), each once per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in C.parts(batch, 1, PART_CHARS):
                words = Words(texts)
                for n in sizes:
                    first, signature = signatures(words, n)
                    at = sieve.value.holds(_keys(signature, n))
                    if len(at):
                        # different runs of a text can have one signature, and equal runs come once
                        found = list(dict.fromkeys((int(words.text[i]), int(x), " ".join(words.run(i, n))) for i, x in zip(first[at].tolist(), signature[at].view(np.int64).tolist(), strict=True)))
                        text, own_signature, own = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), pa.array(np.full(len(own), n, np.int32)), pa.array(own_signature, pa.int64()), pa.array(own)], ["id", "n", "signature", "words"])

    return run


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each item that decide: all of LEAST_WORDS, or its only one of fewer."""
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = Words([text])
            n = min(len(words.hash), LEAST_WORDS)
            if n:
                first, signature = signatures(words, n)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(first), pa.int64()), pa.array([n] * len(first), pa.int32()), pa.array(signature.view(np.int64)), pa.array([" ".join(words.run(i, n)) for i in first.tolist()])], ["id", "n", "signature", "words"])


_RUNS = "id bigint, n int, signature bigint, words string"


def _sieve_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, signature = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        yield pa.RecordBatch.from_arrays([pa.array((signature.view(np.uint64) ^ (n.astype(np.uint64) * np.uint64(C.BASE))).view(np.int64))], ["key"])


def leaked_items(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", sieve_bits: int = C.SIEVE_BITS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, item_id), each once: the document has at least 12 consecutive words of the item, or all of an item with fewer.

    A word is a maximal run of letters and digits in lower case. Null and wordless texts and items match nothing; repeated rows of an id
    count together. Items are partitioned by size (1 to 11 words, and 12 or more, of which every run of 12 counts). In each partition, the
    runs of a document that are as long as the item's are found by the MinHash signature of their shingles: at equal size containment 1
    means equal sets and so equal signatures, and nothing is missed.

    One plan at any size: only runs of sizes that items have are looked at, and only those whose signature passes a sieve of the items'
    signatures (at most `sieve_bits`; a full one passes more and misses none) leave the narrow pass over the documents. They are joined with
    the items' runs by size and signature and verified word by word; signatures with more than `hot_rows` runs are spread over slices.
    """
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("text is not null and doc_id is not null")
    own = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).where("text is not null and item_id is not null")
    wanted = stored(own.mapInArrow(_item_rows, _RUNS).distinct())
    sizes = sorted(r["n"] for r in wanted.select("n").distinct().collect())  # at most LEAST_WORDS
    sieve = C.sieve(wanted.select("n", "signature").distinct().mapInArrow(_sieve_keys, "key bigint"), sieve_bits)
    runs = stored(docs.mapInArrow(_document_runs(sizes, documents.sparkSession.sparkContext.broadcast(sieve)), _RUNS).withColumnRenamed("id", "doc_id"))
    hot = hot_keys(runs, ["n", "signature"], hot_rows)
    met = sliced_join(runs, wanted.select("n", "signature", F.col("words").alias("item_words"), F.col("id").alias("item_id")), ["n", "signature"], hot, ["doc_id"])
    # exact containment: every shingle of the item's run stands at its place in the document's run
    return met.where("words = item_words").select("doc_id", "item_id").distinct()


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """One row per item: (item_id, split_name, n_documents), 0 for items that leaked nowhere."""
    n = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))
    return items.select("item_id", "split_name").join(n, "item_id", "left").select("item_id", "split_name", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))
