"""Mixing sources to target weights, by thresholds on a hash of the record."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Buckets of the hash space at each refinement; the finest bucket is 2**-48 of it after three.
BUCKET_BITS, LEVELS = 16, 3
# Fixed value: how the public byte-level vocabularies split text before their merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Tokenizer:
    """A byte-pair vocabulary: a file of ranks and the pattern that goes with it. Both decide what a token is, so they are given together."""

    path: str
    pattern: str = PATTERN


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(doc_id, source, n_tokens) of each row; a null or empty text has 0 tokens. The driver's vocabulary file is sent to the executors."""
    documents.sparkSession.sparkContext.addFile(tokenizer.path)
    name = os.path.basename(tokenizer.path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(SparkFiles.get(name), tokenizer.pattern).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "n_tokens"])

    return documents.select(F.col("doc_id").cast("bigint"), "source", "text").mapInArrow(run, "doc_id bigint, source string, n_tokens bigint")


def _bucket(level: int):
    """Bucket of a record's hash at a level: its next BUCKET_BITS bits."""
    return F.shiftrightunsigned("h", 64 - BUCKET_BITS * (level + 1)).bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).cast("int")


def mixture_plan(counts: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The plan per source and the counted records with their hash.

    The budget of a source is target_share of `total_tokens` (default: the tokens of all records of target sources). Whole uses of all its
    records come first, up to max_repeats; the rest is the records whose hash is below a threshold. The threshold is found in a histogram
    of tokens by source and hash bucket: the bucket in which the running sum passes the budget is cut again into finer buckets, and the
    others are done. The finest one, of one record but for equal hashes, is taken if that comes nearer to the budget. Thresholds grow with the
    budget, so a smaller mixture is part of a larger one. Nothing is sorted but the buckets.

    Plan: (source, target_share, max_repeats, available, total, budget, full_uses, threshold). Sources without records have available 0; repeated
    target rows of a source add up their shares and keep the least max_repeats; null sources and null or negative shares are left out.
    """
    own = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.greatest(F.min(F.coalesce("max_repeats", F.lit(1))), F.lit(0)).alias("max_repeats"))
    rows = counts.where("source is not null and n_tokens > 0").withColumn("h", F.xxhash64("doc_id", F.lit(42)))
    sums = rows.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    plan = own.join(sums, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    plan = stored(plan)
    if total_tokens is None:
        total_tokens = plan.agg(F.sum("available")).first()[0] or 0
    plan = plan.withColumn("total", F.lit(total_tokens).cast("bigint")).withColumn("budget", F.floor(F.col("target_share") * F.col("total")).cast("bigint"))
    full = F.when(F.col("available") > 0, F.least(F.floor(F.col("budget") / F.col("available")), F.col("max_repeats"))).otherwise(0).cast("int")
    plan = plan.withColumn("full_uses", full)
    rest = F.when((F.col("full_uses") < F.col("max_repeats")) & (F.col("available") > 0), F.col("budget") - F.col("full_uses") * F.col("available")).otherwise(0)
    plan = stored(plan.withColumn("rest", rest.cast("bigint")).withColumn("threshold", F.lit(0).cast("bigint")))
    for level in range(LEVELS):
        # records in the bucket that the threshold has come to so far
        share = rows.join(plan.where("rest > 0").select("source", "threshold"), "source")
        if level:
            done = BUCKET_BITS * level
            share = share.where(F.shiftrightunsigned("h", 64 - done) == F.shiftrightunsigned("threshold", 64 - done))
        buckets = share.groupBy("source", _bucket(level).alias("bucket")).agg(F.sum("n_tokens").alias("tokens"))
        order = Window.partitionBy("source").orderBy("bucket")
        running = buckets.withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        # the first bucket that no longer fits whole, and the tokens before it
        cut = running.join(plan.select("source", "rest"), "source").where("upto > rest").groupBy("source").agg(F.min("bucket").alias("bucket"), F.min(F.col("upto") - F.col("tokens")).alias("before"), F.min_by("tokens", "bucket").alias("tokens"))
        shift = 64 - BUCKET_BITS * (level + 1)
        found = F.col("bucket").isNotNull()
        rest = F.when(found, F.col("rest") - F.col("before")).otherwise(0)
        threshold = F.when(found, F.col("threshold").bitwiseOR(F.shiftleft(F.col("bucket").cast("bigint"), shift))).otherwise(F.col("threshold"))
        if level == LEVELS - 1:
            # the next bucket begins here; after the last one there is none, and all bits are set
            middle = F.lit((1 << 63) - (1 << shift))
            above = F.when(threshold == middle, F.lit(-(1 << 63))).otherwise(threshold + F.lit(1 << shift))
            threshold = F.when(found & (2 * rest >= F.col("tokens")), F.when(above == 0, F.lit(-1)).otherwise(above)).otherwise(threshold)
        plan = stored(plan.join(cut, "source", "left").select("source", "target_share", "max_repeats", "available", "total", "budget", "full_uses", rest.alias("rest"), threshold.alias("threshold")))
    return plan.drop("rest"), rows


def mixture(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, uses) of the records used at least once: a filter against the plan, which has one row per target source."""
    below = (F.shiftrightunsigned("h", 1) < F.shiftrightunsigned("threshold", 1)).cast("int")
    used = rows.join(plan.select("source", "full_uses", "threshold"), "source").withColumn("uses", F.col("full_uses") + below)
    return used.where("uses > 0").select("doc_id", "source", "n_tokens", "uses")


def shares(plan: DataFrame, mixed: DataFrame) -> DataFrame:
    """One row per target source: (source, target_share, max_repeats, available, budget, used, actual_share, share_of_total, most_uses, falls_short).

    actual_share is of all tokens used, share_of_total of the tokens asked for: where sources fall short, the others have their target share
    of the latter and more than it of the former, since nothing takes the place of what is missing. A source falls short if all its records at max_repeats are less than its budget.
    """
    sums = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used"), F.max("uses").alias("most_uses"))
    got = plan.join(sums, "source", "left").withColumn("used", F.coalesce("used", F.lit(0))).withColumn("most_uses", F.coalesce("most_uses", F.lit(0)))
    whole = got.agg(F.sum("used")).first()[0] or 0
    actual = F.col("used") / F.lit(whole) if whole else F.lit(0.0)
    return got.select("source", "target_share", "max_repeats", "available", "budget", "used", actual.alias("actual_share"), F.when(F.col("total") > 0, F.col("used") / F.col("total")).otherwise(0.0).alias("share_of_total"), "most_uses", (F.col("available") * F.col("max_repeats") < F.col("budget")).alias("falls_short"))
