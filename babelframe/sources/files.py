"""Readers of the collections' text files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, strip


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, file_path, line_no, value): lines of text files with their place; each file is read whole, for files of judgments and rankings."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("file_path"), "value")
    return raw.select("file_name", "file_path", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value")).where("value <> ''")


def language_of_file(name: Column) -> Column:
    """The last three characters of a judgment file's name."""
    return F.right(name, F.lit(3))


def language_of_folder(path: Column) -> Column:
    """The folder in which a file lies."""
    return F.element_at(F.split(path, "/"), -2)


def target_of_name(name: Column) -> Column:
    """The second language of a name like a_b, or the name itself."""
    return F.coalesce(F.get(F.split(name, "_"), F.lit(1)), name)


def spaced_judgments(rows: DataFrame) -> DataFrame:
    """(file_name, line_no, query_id, doc_id, rel) of lines cut at each single blank: first, third and last field; unreadable relevance is null."""
    w = F.split("value", " ")
    return rows.select("file_name", "line_no", F.get(w, F.lit(0)).alias("query_id"), F.get(w, F.lit(2)).alias("doc_id"), F.element_at(w, -1).try_cast("int").alias("rel"))


def four_field_judgments(rows: DataFrame, strict: bool = False) -> DataFrame:
    """(file_name, line_no, query_id, doc_id, relevance) of lines with four fields parted by white space; others are left out, or an error if strict."""
    w = F.split(clean_text(F.col("value")), " ")
    ok = F.size(w) == 4
    kept = rows if strict else rows.where(ok)
    first = F.when(ok, w[0]).otherwise(F.raise_error(F.concat(F.lit("not four fields: "), F.col("value")))) if strict else w[0]
    return kept.select("file_name", "line_no", first.alias("query_id"), w[2].alias("doc_id"), w[3].alias("relevance"))


def json_documents(rows: DataFrame, value: str = "value", null_as_text: bool = False) -> DataFrame:
    """(doc_id, text) of lines of JSON objects with id, title and text: title and text joined by a blank and cleaned.

    Lines that are blank, no JSON or no object, and rows whose id or text is empty, are dropped. A missing member is empty; so is null, or the
    text None with `null_as_text`. Numbers come as JSON writes them.
    """
    v = F.try_parse_json(value)

    def member(key: str) -> Column:
        x = F.variant_get("v", f"$.{key}", "variant")
        null = F.lit("None" if null_as_text else "")
        return F.when(x.isNull(), "").when(F.is_variant_null(x), null).otherwise(F.coalesce(F.try_variant_get("v", f"$.{key}", "string"), F.lit("")))

    parsed = rows.select(v.alias("v")).where("v is not null and schema_of_variant(v) like 'OBJECT%'")
    return parsed.select(strip(member("id")).alias("doc_id"), clean_text(F.concat(member("title"), F.lit(" "), member("text"))).alias("text")).where("doc_id <> '' and text <> ''")


def two_columns(rows: DataFrame, value: str = "value") -> DataFrame:
    """(id, text) of lines cut at the first tab, both stripped; lines without tab are dropped. Quotes have no meaning."""
    w = F.split(value, "\t", 2)
    return rows.where(F.col(value).contains("\t")).select(strip(w[0]).alias("id"), strip(w[1]).alias("text"))


def quoted_columns(rows: DataFrame, value: str = "value") -> DataFrame:
    """The rows with `cols`, the tab-separated fields of a line of any width; a quoted field may hold tabs, and two quotes in it mean one. Empty lines go."""
    # possessive: a group that can give back takes a stack frame for each repetition, and long fields would end the executor
    raw = F.regexp_extract_all(F.concat(F.lit("\t"), F.col(value)), F.lit(r'\t(?:"(?:[^"]|"")*+"(?=\t|$)|[^\t]*)'), 0)

    def plain(x: Column) -> Column:
        field = F.substring(x, 2, 2**31 - 1)
        quoted = (F.length(field) > 1) & field.startswith('"') & field.endswith('"')
        return F.when(quoted, F.replace(F.substring(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))).otherwise(field)

    return rows.where(F.col(value) != "").withColumn("cols", F.transform(raw, plain))


def lexicon_entries(spark: SparkSession, path: str) -> DataFrame:
    """(pos, key, value) of a file that is one JSON object, value as JSON text; a later entry of a repeated key has a later position."""
    raw = spark.read.text(path, wholetext=True)
    pairs = F.map_entries(F.from_json("value", "map<string,string>"))
    e = raw.select(F.posexplode(pairs).alias("pos", "e")).select(F.col("pos").cast("bigint").alias("pos"), F.col("e.key").alias("key"), F.col("e.value").alias("v"))
    return e.select("pos", "key", F.when(F.ltrim("v").startswith("["), F.col("v")).when(F.col("v").isNull(), "null").otherwise(F.substring(F.to_json(F.array("v")), 2, 2**31 - 1)).alias("value")).withColumn("value", F.when(F.ltrim("value").startswith("[") | (F.col("value") == "null"), F.col("value")).otherwise(F.regexp_replace("value", r"\]$", "")))


def rankings(rows: DataFrame) -> DataFrame:
    """(qid, rank, doc_id, score) of ranking files named by query number, or lying in a folder qid=number, `doc_id tab score` in order; rank counts from 0, a missing score is null."""
    w = F.split("value", "\t")
    qid = F.coalesce(F.regexp_extract("file_path", r"/qid=(\d+)/[^/]*$", 1).try_cast("int"), F.regexp_extract("file_name", r"^(\d+)", 1).try_cast("int"))
    return rows.select(qid.alias("qid"), F.col("line_no").alias("rank"), strip(w[0]).alias("doc_id"), F.get(w, F.lit(1)).try_cast("double").alias("score")).where("qid is not null")


def rerank_corpus(ranked: DataFrame, top: int) -> DataFrame:
    """Different documents among the first `top` of any query. A negative `top` means no limit on the collection: use no corpus then."""
    return ranked.where(F.col("rank") < top).select("doc_id").distinct()


def id_list(rows: DataFrame) -> DataFrame:
    """(pos, id, md5) of id files name.N.jsonl in numeric order of N, then of lines; positions are increasing, not dense."""
    file_no = F.get(F.split("file_name", r"\."), F.lit(1)).try_cast("bigint")
    pos = file_no * F.lit(1 << 40) + F.col("line_no")
    return rows.select(pos.alias("pos"), F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.md5").alias("md5"))


def limited_over_files(rows: DataFrame, limit: int) -> DataFrame:
    """Rows (path, at, ...) as a reader gets them that takes the first `limit` of each file and stops after the file in which their number
    reaches `limit`, files in the order of their paths; so they may be more than `limit` in all. Counts are one row per file.
    """
    own = limited_per_file(rows, limit)
    counts = own.groupBy("path").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    read = counts.select("path", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")).where(F.col("_before") < limit).select("path")
    return own.join(read, "path", "left_semi")


def limited_per_file(rows: DataFrame, limit: int, order: str = "at") -> DataFrame:
    """The first `limit` rows of each file; a file is one task's input, so its window is bounded by it."""
    place = F.row_number().over(Window.partitionBy("path").orderBy(order))
    return rows.withColumn("_n", place).where(F.col("_n") <= limit).drop("_n")
