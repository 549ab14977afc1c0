"""Writers of plain text outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tsv_line(*columns: str) -> Column:
    """Columns joined by tabs, line breaks and tabs inside them as blanks; null is empty."""
    return F.concat_ws("\t", *[F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]+", " ") for c in columns])


def tsv_lines(df: DataFrame, *columns: str) -> DataFrame:
    """(value) with tsv_line."""
    return df.select(tsv_line(*columns).alias("value"))


def trec_line(rel: Column | None = None) -> Column:
    """`query 0 document relevance` of (qid, doc_id) joined by tabs; relevance 1 where there is none."""
    r = F.lit(1) if rel is None else F.coalesce(rel, F.lit(1))
    return F.concat_ws("\t", F.col("qid").cast("string"), F.lit("0"), "doc_id", r.cast("string"))


def trec_lines(df: DataFrame, rel: Column | None = None) -> DataFrame:
    """(value) with trec_line."""
    return df.select(trec_line(rel).alias("value"))


def quoted_lines(df: DataFrame, *columns: str) -> DataFrame:
    """(value): tab-separated with fields quoted where they hold a quote, tab or line break."""

    def cell(c: str) -> Column:
        x = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(x.rlike('["\t\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)

    return df.select(F.concat_ws("\t", *map(cell, columns)).alias("value"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder lies at the path, on any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished output lies at the path: its success mark, not its mere folder."""
    return path_exists(spark, f"{path}/_SUCCESS")


def write_lines(lines: DataFrame, path: str, order: list[str] | None = None, skip_finished: bool = True, line_end: str = "\n") -> bool:
    """Writes (value) as text, in the order of the given columns over the part files; says whether it wrote. A finished output is left alone."""
    if skip_finished and exists(lines.sparkSession, path):
        return False
    if order:
        lines = lines.orderBy(*order)
    lines.select("value").write.mode("overwrite").option("lineSep", line_end).text(path)
    return True


def name_of(lang: str, year: str, kind: str, tokenizer: str | None = None, length: int = 180, overlap: int = 90) -> str:
    """Output name: {lang}_{year}_{kind}.tsv, for passages and mappings with tokenizer and sizes, `/` in its name as `_`."""
    cut = f"_{(tokenizer or 'whitespace').replace('/', '_')}_{length}_{overlap}" if kind in ("passages", "mapping") else ""
    return f"{lang}_{year}_{kind}{cut}.tsv"
