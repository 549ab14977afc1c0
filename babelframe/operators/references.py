"""References to records that do not exist: the stream of references and the stream of parent changes are co-partitioned by key,
sorted by time and merged in one linear pass that keeps the number of parent rows in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import hot_keys, repeated, sliced

#: A key with more references than this is spread over several tasks, each of which gets the key's parent rows too.
HOT_KEY_ROWS = 50_000
_KEY = ["ref_field", "key"]


def merged(refs: DataFrame, parents: DataFrame, hot_key_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """References without a parent in force at their time: (ref_field, ref_id, ref_key, ref_time, reason).

    `refs` has (ref_field, ref_id, key, t), `parents` (ref_field, key, a, b), so that references of several fields share one pass and one
    shuffle. See orphan_references for what counts. Hot keys are found by a sketch and sliced before anything is shuffled; then both streams
    are hashed by (field, key, slice) and sorted once, and running sums over the sorted stream are the merge.
    """
    hot = hot_keys(refs, _KEY, hot_key_rows)
    r = sliced(refs, _KEY, hot, ["ref_id"])
    p = repeated(parents, _KEY, hot)
    none = F.lit(None).cast(refs.schema["ref_id"].dataType)
    in_force = F.col("a").isNotNull() & (F.col("b").isNull() | (F.col("b") > F.col("a")))
    # at equal times starts and ends come before references: a row is in force at its start and no longer at its end
    starts = F.struct(F.col("a").alias("t"), F.lit(0).alias("kind"), F.when(in_force, 1).otherwise(0).alias("step"))
    ends = F.when(F.col("b") > F.col("a"), F.struct(F.col("b").alias("t"), F.lit(1).alias("kind"), F.lit(-1).alias("step")))
    changes = p.select(*_KEY, "slice", F.explode(F.array_compact(F.array(starts, ends))).alias("e")).select(*_KEY, "slice", "e.*", none.alias("ref_id"))
    marks = r.select(*_KEY, "slice", "t", F.lit(2).alias("kind"), F.lit(0).alias("step"), "ref_id")
    order = Window.partitionBy(*_KEY, "slice").orderBy(F.col("t").asc_nulls_first(), "kind")
    upto, whole = (order.rowsBetween(Window.unboundedPreceding, end) for end in (Window.currentRow, Window.unboundedFollowing))
    start = (F.col("kind") == 0).cast("int")
    return (
        changes.unionByName(marks)
        .withColumn("in_force", F.sum("step").over(upto))
        .withColumn("begun", F.sum(F.when(F.col("t").isNotNull(), start).otherwise(0)).over(upto))
        .withColumn("known", F.sum(start).over(whole))
        .where("kind = 2 and if(t is null, known = 0, in_force = 0)")
        .select("ref_field", "ref_id", F.col("key").alias("ref_key"), F.col("t").alias("ref_time"), F.when(F.col("known") == 0, "missing").when(F.col("begun") == 0, "late").otherwise("deleted").alias("reason"))
    )


def parents_of(field: str, parents: DataFrame, key: Column, valid_from: Column, valid_to: Column) -> DataFrame:
    """Parent rows of one field for `merged`; null keys are left out."""
    return parents.select(F.lit(field).alias("ref_field"), key.alias("key"), valid_from.alias("a"), valid_to.alias("b")).where("key is not null")


def orphan_references(
    refs: DataFrame,
    parents: DataFrame,
    *,
    ref_id: str,
    ref_key: Column,
    ref_time: Column,
    parent_key: Column,
    valid_from: Column,
    valid_to: Column,
    hot_key_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """References without a parent in force at their time, as (ref_id, ref_key, ref_time, reason).

    A parent row is in force from `valid_from` to before `valid_to` (null: for ever; a null `valid_from`: never, though its key is known).
    reason is `missing` (no parent row has the key), `late` (all of them start after the reference) or `deleted` (none that had
    started is still in force). A null reference key is no reference. A reference with null time is an orphan only if its key is missing.
    Blanks at both ends of the reference key are removed; a blank one refers to the empty key. Repeated references count each, repeated
    parent rows change nothing. Other columns of either table play no part, whatever their names.
    """
    r = refs.select(F.lit("").alias("ref_field"), F.col(ref_id).alias("ref_id"), F.trim(ref_key).alias("key"), ref_time.alias("t")).where("key is not null")
    return merged(r, parents_of("", parents, parent_key, valid_from, valid_to), hot_key_rows).drop("ref_field")


def qrels_orphans(qrels: DataFrame, documents: DataFrame, topics: DataFrame, hot_key_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Judgments whose doc_id or query_id refers to nothing in force at judged_at: (ref_field, judged_month, qrel_id, reason).

    The month is that of judged_at, `none` where it is null. Empty tables give an empty result, an empty parent table makes every reference missing.
    """
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("ref_field"), F.trim(c).alias("key")) for c in ("doc_id", "query_id")]))
    refs = qrels.select(F.col("qrel_id").alias("ref_id"), F.col("judged_at").alias("t"), both.alias("r")).select("r.ref_field", "ref_id", "r.key", "t").where("key is not null")
    force = dict(valid_from=F.col("loaded_at"), valid_to=F.col("deleted_at"))
    parents = parents_of("doc_id", documents, F.col("doc_id"), **force).unionByName(parents_of("query_id", topics, F.col("topic_id"), **force))
    month = F.coalesce(F.date_format("ref_time", "yyyy-MM"), F.lit("none"))
    return merged(refs, parents, hot_key_rows).select("ref_field", month.alias("judged_month"), F.col("ref_id").alias("qrel_id"), "reason")
