"""Long exact spans shared between records."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, repeated, sliced, sliced_join
from ..session import stored
from . import codes as C
from .fmindex import shared_intervals

#: Characters of an anchor; a power of two below the least span.
ANCHOR = 32
#: Characters hashed at once in a task, and characters of one shard's index.
PART_CHARS, SHARD_CHARS = 2_000_000, 1_000_000
#: Anchors with more different segments than this have their shards cut by what stands beside the anchor.
SHARD_SEGMENTS = 4_000
#: Places of one anchor or segment from which on they are spread over several tasks.
HOT_ROWS = 50_000


def _anchors_of(codes: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of anchors: of each run of `least` characters within a text, the gram with the least hash, the last such."""
    grams = C.gram_hashes(codes, ANCHOR)
    low = np.uint64((1 << 28) - 1)
    tagged = (grams & ~low) | (low - np.arange(len(codes), dtype=np.uint64))
    chosen = C.window_least(tagged, least - ANCHOR + 1)[: max(0, len(codes) - least + 1)]
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = doc[: len(chosen)] == doc[least - 1 : least - 1 + len(chosen)]
    at = np.unique((low - (chosen[inside] & low)).astype(np.int64))
    return at, grams[at]


def _anchor_rows(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in C.parts(batch, 1, PART_CHARS):
                codes, starts = C.code_points(texts)
                if len(codes) < least:
                    continue
                at, grams = _anchors_of(codes, starts, least)
                doc = np.searchsorted(starts, at, "right") - 1
                a, b = np.maximum(starts[doc], at - (least - ANCHOR)), np.minimum(starts[doc + 1], at + least)
                seg = C.RangeHash(codes).of(a, b)
                ids = part.column(0).to_numpy(zero_copy_only=False)[doc]
                cols = [grams.view(np.int64), seg.view(np.int64), ids, (a - starts[doc]).astype(np.int32), (at - a).astype(np.int32), (b - a).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["anchor", "seg", "doc_id", "start_at", "anchor_at", "size"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of each document as text; one that has not the segment's hash was cut from another text under the same id and goes."""
    names = ["anchor", "seg", "low_doc", "high_doc", "anchor_at", "segment"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    for batch in batches:
        rows = []
        for doc, text, segs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            rows += [(s["anchor"], s["seg"], doc, s["high_doc"], s["anchor_at"], text[s["start_at"] : s["start_at"] + s["size"]]) for s in segs]
        if rows:
            codes, starts = C.code_points([r[5] for r in rows])
            true = C.RangeHash(codes).of(starts[:-1], starts[1:]).view(np.int64) == np.array([r[1] for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names).filter(pa.array(true))


def _search(least: int, shard_chars: int):
    """One index after another over the segments of a partition, sorted by shard; each holds whole shards."""

    def one(rows: list[tuple]) -> pa.RecordBatch:
        _, anchor, seg, low, high, at, text = zip(*rows, strict=True)
        codes, starts = C.code_points(list(text))
        symbols = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
        pieces = [symbols[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        which, a, b = shared_intervals(pieces, np.array(at), np.array(low), np.array(high), least, ANCHOR)
        return pa.RecordBatch.from_arrays([pa.array(np.array(anchor)[which]), pa.array(np.array(seg)[which]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["anchor", "seg", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= shard_chars and row[0] != rows[-1][0]:
                    yield one(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[6])
        if rows:
            yield one(rows)

    return run


def _passes(sieve: Broadcast):
    @F.pandas_udf("boolean")
    def passes(ids: pd.Series) -> pd.Series:
        got = np.zeros(len(ids), bool)
        got[sieve.value.holds(ids.to_numpy(np.int64).view(np.uint64))] = True
        return pd.Series(got)

    return passes


def _sharded(cut: DataFrame, least: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Segments in shards of at most `most`, so that any two that share a span around their anchor meet in one; and spans found on the way.

    A shard is first an anchor. The segments of a crowded one agree on `left` characters before the anchor and `right` after it. Two that
    share a span agree on least - ANCHOR characters around it, so they agree further by half of what is missing on one side or the other, and
    meet in the shard of those that have the same next characters there. Once nothing is missing, the context is a whole span: all that
    have it share it, as a comparison of the text shows, and longer spans are made up of such ones.
    """
    around = least - ANCHOR
    rest = cut.select(F.col("anchor").alias("shard"), "anchor", "seg", "low_doc", "high_doc", "anchor_at", "segment", F.lit(0).alias("left"), F.lit(0).alias("right"))
    ready: DataFrame | None = None
    whole: DataFrame | None = None
    while True:
        crowded = rest.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("low_doc").alias("a"), F.max("high_doc").alias("b")).where((F.col("n") > most) & (F.col("a") < F.col("b"))).select("shard", F.lit(True).alias("crowded"))
        crowded = stored(crowded)
        if crowded.isEmpty():
            break
        hot = hot_keys(rest, ["shard"], most)
        marked = stored(sliced(rest, ["shard"], hot, ["seg"]).join(repeated(crowded, ["shard"], hot), ["shard", "slice"], "left").drop("slice"))
        calm = marked.where("crowded is null").drop("crowded")
        ready = calm if ready is None else ready.unionByName(calm)
        busy = marked.where("crowded").drop("crowded")
        missing = F.lit(around) - F.col("left") - F.col("right")
        half = F.ceil(missing / 2).cast("int")
        done = busy.where(missing <= 0)
        context = F.substring("segment", F.col("anchor_at") - F.col("left") + 1, F.col("left") + ANCHOR + F.col("right"))
        both = done.select("anchor", "seg", "low_doc", "high_doc", context.alias("context"), (F.col("anchor_at") - F.col("left")).alias("a"), (F.col("anchor_at") + ANCHOR + F.col("right")).alias("b"))
        common = both.groupBy("context").agg(F.min("low_doc").alias("low"), F.max("high_doc").alias("high")).where("low < high").select("context")
        spans = sliced_join(both, common, ["context"], hot_keys(both, ["context"], most), ["seg"]).select("anchor", "seg", "a", "b")
        whole = spans if whole is None else whole.unionByName(spans)
        longer = F.array(F.struct((F.col("left") + half).alias("l"), F.col("right").alias("r")), F.struct(F.col("left").alias("l"), (F.col("right") + missing - half + 1).alias("r")))
        parts = busy.where(missing > 0).withColumn("c", F.explode(longer)).where((F.col("c.l") <= F.col("anchor_at")) & (F.col("anchor_at") + ANCHOR + F.col("c.r") <= F.length("segment")))
        parts = parts.withColumn("left", F.col("c.l")).withColumn("right", F.col("c.r")).drop("c")
        rest = stored(parts.withColumn("shard", F.xxhash64("left", "right", context)))
    return (rest if ready is None else ready.unionByName(rest)).drop("left", "right"), whole


def shared_spans(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 260, shard_segments: int = SHARD_SEGMENTS, shard_chars: int = SHARD_CHARS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, start_at, end_at): parts of each text covered by spans of at least `least` characters that stand in another document too.

    Positions are code points, 0-based, end exclusive; parts that overlap or touch are one row. Null and shorter texts have none. Equal texts
    under different ids share all. A doc_id that comes twice is one document: what only its own rows share is not shared.

    Every run of `least` characters has an anchor, chosen by its content alone, so documents that share a run share an anchor at the same
    place of it. Only anchors of several documents go on; what stands around them is hashed first, so that copies travel once (segments of
    one anchor with equal 64-bit hashes count as equal), and is cut from one holder's text: only holders' texts are shuffled, as far as a
    sieve of their ids can tell. Segments are sharded by anchor, each shard gets an FM-index, and each segment is streamed through it. An
    anchor with more than `shard_segments` different segments has its shards cut by the characters beside it. Anchors and segments that more
    than `hot_rows` places have are spread over slices wherever places are joined.
    """
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") >= least)
    docs = docs.where("doc_id is not null")
    rows = stored(docs.mapInArrow(_anchor_rows(least), "anchor bigint, seg bigint, doc_id bigint, start_at int, anchor_at int, size int"))
    several = rows.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    held = stored(sliced_join(rows, several, ["anchor"], hot_keys(rows, ["anchor"], hot_rows), ["doc_id", "start_at"]))
    different = stored(held.groupBy("anchor", "seg").agg(F.min(F.struct("doc_id", "start_at", "anchor_at", "size")).alias("one"), F.max("doc_id").alias("high_doc")))
    holders = different.select(F.col("one.doc_id").alias("doc_id"))
    passes = _passes(documents.sparkSession.sparkContext.broadcast(C.sieve(holders.distinct())))
    chosen = different.groupBy(F.col("one.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("anchor", "seg", "high_doc", "one.start_at", "one.anchor_at", "one.size")).alias("segs"))
    cut = docs.where(passes("doc_id")).join(chosen, "doc_id").select("doc_id", "text", "segs").mapInArrow(_cut, "anchor bigint, seg bigint, low_doc bigint, high_doc bigint, anchor_at int, segment string")
    shards, whole = _sharded(stored(cut), least, shard_segments)
    found = shards.repartition("shard").sortWithinPartitions("shard", "seg").mapInArrow(_search(least, shard_chars), "anchor bigint, seg bigint, a int, b int")
    found = found if whole is None else found.unionByName(whole)
    spans = sliced_join(held, found, ["anchor", "seg"], hot_keys(held, ["anchor", "seg"], hot_rows), ["doc_id", "start_at"])
    spans = spans.select("doc_id", (F.col("start_at") + F.col("a")).cast("bigint").alias("a"), (F.col("start_at") + F.col("b")).cast("bigint").alias("b")).distinct()
    order = Window.partitionBy("doc_id").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum((F.coalesce(reach, F.lit(-1)) < F.col("a")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return spans.withColumn("part", part).groupBy("doc_id", "part").agg(F.min("a").alias("start_at"), F.max("b").alias("end_at")).drop("part")


def shared_amount(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per document: (doc_id, n_chars, shared_chars, shared_share), 0 where nothing is shared; null texts have 0 characters."""
    sums = spans.groupBy("doc_id").agg(F.sum(F.col("end_at") - F.col("start_at")).alias("shared_chars"))
    size = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars"))
    return size.join(sums, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars")).withColumn("shared_share", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(0.0))
