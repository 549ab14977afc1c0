"""Dense numbers, given orders and integrity checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..functions.text import document_hash
from ..session import stored

#: monotonically_increasing_id() has the partition above these bits and the row's place in it below.
_PLACE_BITS = 33


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a weight, as the sum of the weights before it in the partition, and the weight."""
    total = 0
    for batch in batches:
        w = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.cumsum(w) - w + total
        total += int(w.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(before), pa.array(w)], [*batch.schema.names[:-1], "_before", "_weight"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a group, replaced by the row's place in its run of equal values in the partition."""
    last, length = object(), 0
    for batch in batches:
        g = batch.column(batch.num_columns - 1)
        if not batch.num_rows:
            continue
        code = g.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        first = np.concatenate([[True], code[1:] != code[:-1]])
        at = np.arange(batch.num_rows)
        start = np.maximum.accumulate(np.where(first, at, 0))
        place = at - start
        if g[0].as_py() == last:
            place[start == 0] += length
        last, length = g[batch.num_rows - 1].as_py(), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(place.astype(np.int64))], [*batch.schema.names[:-1], "_run"])


def _in_order(df: DataFrame, order: list[str]) -> DataFrame:
    return df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())


def _with(schema: StructType, *names: str) -> StructType:
    return StructType([*schema.fields, *(StructType().add(n, LongType()).fields[0] for n in names)])


def numbered(df: DataFrame, order: list[str], name: str = "idx", weight: str | None = None) -> DataFrame:
    """Dense 0-based numbers in the order of the columns, which together are unique; an empty frame stays empty.

    With `weight` (a column of counts), each row gets the first number of a block of so many: the sum of the weights before it.

    One range shuffle. A row's number is its place in the sorted partition plus the rows of earlier partitions, of which one row per
    partition is gathered. The partitioned rows are written once, since range bounds are sampled and both uses must see the same ones; so give
    keys only and join the rest.
    """
    rows = _in_order(df, order)
    if weight is not None:
        rows = rows.withColumn("_w", F.coalesce(F.col(weight), F.lit(0)).cast("bigint")).mapInArrow(_running, _with(rows.schema, "_before", "_weight"))
    rows = stored(rows.withColumn("_part", F.shiftright("_m", _PLACE_BITS)))
    before = F.col("_m").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)) if weight is None else F.col("_before")
    size = F.max(before + 1) if weight is None else F.sum("_weight")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_part").agg(size.alias("_size")).select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    # one row per partition
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_offset") + before).cast("bigint")).select(*df.columns, name)


def last_wins(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """For each key the values of its last row in the order; ties are broken by the values themselves. Map-side combined."""
    last = F.max_by(F.struct(*values), F.struct(*order, *values)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{v}").alias(v) for v in values])


def missing_ids(ids: DataFrame, docs: DataFrame, id_col: str = "id") -> DataFrame:
    """Different ids of the list that no document has; null ids are left out."""
    return ids.select(id_col).where(F.col(id_col).isNotNull()).distinct().join(docs.select(id_col), id_col, "left_anti")


def reordered(ids: DataFrame, docs: DataFrame, complete: bool = True) -> DataFrame:
    """Documents (id, ...) joined to the list (pos, id) whose positions give the order; an id listed twice comes twice.

    With complete, a listed id without document is an error when that row is read. Documents off the list are dropped. The order is a
    column; sort by `pos` at the sink.
    """
    got = ids.select("pos", "id").join(docs.withColumn("_there", F.lit(True)), "id", "left" if complete else "inner")
    if complete:
        there = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("listed document is missing: "), F.col("id")))).otherwise(F.col("pos"))
        got = got.withColumn("pos", there)
    return got.drop("_there")


def hash_mismatches(docs: DataFrame, expected: DataFrame, title: Column, text: Column) -> DataFrame:
    """(id, expected, found) of documents whose hash differs from the listed one; documents off the list are no mismatch."""
    found = docs.select("id", document_hash(title, text).alias("found"))
    return found.join(expected.select("id", F.col("md5").alias("expected")), "id").where("found <> expected").select("id", "expected", "found")


def shard(df: DataFrame, pos: str, shards: int) -> DataFrame:
    """Strided assignment: row at position p goes to shard p modulo the number of shards."""
    return df.withColumn("shard", F.pmod(F.col(pos), F.lit(shards)).cast("int"))


def per_group_position(df: DataFrame, group: str, order: list[str], name: str = "pos") -> DataFrame:
    """0-based position of each row in its group, also where a group is too large for one task; rows without group are a group.

    One range shuffle: a row's position is its place in the group's run within the sorted partition, and only the run that a partition begins
    with may go on from earlier partitions. Of each partition one row is gathered for that.
    """
    rows = _in_order(df, [group, *order])
    rows = rows.withColumn("_g", F.col(group)).mapInArrow(_runs, _with(rows.schema, "_run"))
    rows = stored(rows.withColumn("_part", F.shiftright("_m", _PLACE_BITS)))
    ends = rows.groupBy("_part").agg(F.min_by(F.struct(group), "_m").alias("_g"), F.max_by(F.struct(F.struct(group).alias("g"), (F.col("_run") + 1).alias("n")), "_m").alias("_end"))
    last = ends.select("_part", F.col("_end.g").alias("_g"), F.col("_end.n").alias("_n"), F.lit(1).alias("_last"))
    first = ends.select("_part", "_g", F.lit(0).cast("bigint").alias("_n"), F.lit(0).alias("_last"))
    # a partition's own end is not before its beginning; earlier ones are, by partition
    earlier = Window.partitionBy("_g").orderBy("_part").rangeBetween(Window.unboundedPreceding, -1)
    carried = last.unionByName(first).withColumn("_carry", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).where("_last = 0").select("_part", F.col("_g").alias("_first"), "_carry")
    goes_on = F.when(F.struct(group) == F.col("_first"), F.col("_carry")).otherwise(0)
    # one row per partition
    return rows.join(F.broadcast(carried), "_part").withColumn(name, F.col("_run") + goes_on).select(*df.columns, name)
