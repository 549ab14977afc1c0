"""Joins and windows on keys of which a few hold much of the rows: these are found by a sketch and cut into slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most keys that can be hot, whatever the size of the data: a key is hot from this part of all rows on. It bounds what is broadcast.
MOST_HOT = 1000
#: Keys that each task's sketch keeps; any key with MOST_HOT's part of the rows is among them.
_TRACKED = 4096


def hot_keys(rows: DataFrame, keys: list[str], least_rows: int) -> list[tuple[int, int]]:
    """(hash of the key, slices) of keys with more than `least_rows` rows and more than 1 / MOST_HOT of all; at most MOST_HOT of them.

    One narrow pass over the keys: only sketches of bounded size are gathered. Counts are estimates; slices are a matter of balance, not of results.
    """
    h = rows.select(F.xxhash64(*keys).alias("h"))
    got = h.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {MOST_HOT}, {_TRACKED})").alias("top")).first()
    floor = max(least_rows, -(-got["n"] // MOST_HOT))
    return [(r["item"], -(-r["count"] // floor)) for r in got["top"] or [] if r["count"] > floor]


def _marked(rows: DataFrame, keys: list[str], hot: list[tuple[int, int]]) -> DataFrame:
    # at most MOST_HOT rows
    found = F.broadcast(rows.sparkSession.createDataFrame(hot, "_h bigint, _slices bigint"))
    return rows.join(found, F.xxhash64(*keys) == F.col("_h"), "left").drop("_h")


def sliced(rows: DataFrame, keys: list[str], hot: list[tuple[int, int]], spread: list[str]) -> DataFrame:
    """The rows with `slice`: 0, or for hot keys one of their slices by the columns `spread`."""
    if not hot:
        return rows.withColumn("slice", F.lit(0))
    own = F.when(F.col("_slices").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread, F.lit(7)), F.col("_slices"))).cast("int")
    return _marked(rows, keys, hot).withColumn("slice", own).drop("_slices")


def repeated(rows: DataFrame, keys: list[str], hot: list[tuple[int, int]]) -> DataFrame:
    """The rows with `slice`, those of hot keys once for each of its slices."""
    if not hot:
        return rows.withColumn("slice", F.lit(0))
    last = F.coalesce(F.col("_slices"), F.lit(1)).cast("int") - 1
    return _marked(rows, keys, hot).withColumn("slice", F.explode(F.sequence(F.lit(0), last))).drop("_slices")


def sliced_join(many: DataFrame, few: DataFrame, keys: list[str], hot: list[tuple[int, int]], spread: list[str]) -> DataFrame:
    """Inner join of many rows with few per key: hot keys of `many` are spread over slices, to each of which the key's rows of `few` go."""
    return sliced(many, keys, hot, spread).join(repeated(few, keys, hot), [*keys, "slice"]).drop("slice")
