"""Code-switched queries from a lexicon."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import choice, join_tokens, join_treebank, match_case, strip, tokens, treebank_tokens, uniform, word_tokens

#: How a text becomes tokens and tokens a text.
TOKENIZERS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {
    "whitespace": (tokens, lambda x: F.array_join(x, " ")),
    "words": (word_tokens, join_tokens),
    "treebank": (treebank_tokens, join_treebank),
}


def normalized_lexicon(entries: DataFrame) -> DataFrame:
    """(word, candidates) of entries (pos, key, value), value being JSON text of a string or of a list of strings.

    Words are stripped and lowered, candidates stripped; empty ones, nulls and words without candidates go; of a repeated word the last entry wins.
    """
    word = F.lower(strip(F.col("key")))
    many = F.from_json("value", "array<string>")
    one = F.get_json_object(F.concat(F.lit('{"x":'), F.col("value"), F.lit("}")), "$.x")
    given = F.when(F.ltrim("value").startswith("["), many).otherwise(F.array(one))
    kept = F.filter(F.transform(given, strip), lambda c: c.isNotNull() & (c != ""))
    rows = entries.select("pos", word.alias("word"), kept.alias("candidates")).where("word <> '' and size(candidates) > 0")
    return rows.groupBy("word").agg(F.max_by("candidates", F.struct("pos", "candidates")).alias("candidates"))


def switched(rows: DataFrame, lexicon: DataFrame, probability: float = 0.5, seed: int = 13, row_key: str = "row_key", text: str = "text", tokenizer: str = "whitespace") -> DataFrame:
    """(row_key, text, n_switches): each token with candidates is replaced with the probability by one of them, in the token's case.

    The draw depends on seed, row key and token position, not on the order of rows. A text without a hit stays byte for byte as it is; one with
    hits has its tokens joined again. Entries of several words never match. Null texts stay null. row_key must be unique.

    Only tokens, not texts, are joined with the lexicon; Spark broadcasts it if its size allows.
    """
    cut, join = TOKENIZERS[tokenizer]
    base = rows.select(F.col(row_key).alias("row_key"), F.col(text).alias("text"))
    parts = base.select("row_key", F.posexplode(cut(F.col("text"))).alias("at", "token")).withColumn("word", F.lower("token"))
    pos = F.col("at").cast("string")
    key = F.col("row_key").cast("string")
    hits = parts.join(lexicon.select("word", "candidates"), "word").where(uniform(seed, key, pos) < probability)
    pick = F.element_at("candidates", choice(F.size("candidates"), seed, key, pos) + 1)
    changes = hits.select("row_key", "at", match_case(pick, F.col("token")).alias("new")).groupBy("row_key").agg(F.map_from_entries(F.collect_list(F.struct("at", "new"))).alias("new"))
    got = base.join(changes, "row_key", "left")
    joined = join(F.transform(cut(F.col("text")), lambda t, i: F.coalesce(F.try_element_at("new", i), t)))
    return got.select("row_key", F.when(F.col("new").isNull(), F.col("text")).otherwise(joined).alias("text"), F.coalesce(F.size("new"), F.lit(0)).alias("n_switches"))


def switched_columns(rows: DataFrame, lexicon: DataFrame, **options) -> DataFrame:
    """(row_key, cols, n_switches) of rows (row_key, cols) of any width: the last column is switched, rows of one column or none pass as they are."""
    last = rows.select("row_key", F.when(F.size("cols") > 1, F.element_at("cols", -1)).alias("text"))
    got = switched(last, lexicon, **options).withColumnRenamed("text", "_new")
    cols = F.when(F.size("cols") > 1, F.concat(F.slice("cols", F.lit(1), F.size("cols") - 1), F.array("_new"))).otherwise(F.col("cols"))
    return rows.join(got, "row_key").select("row_key", cols.alias("cols"), "n_switches")


def switch_statistics(result: DataFrame) -> DataFrame:
    """One row: rows, switched rows, switches, rate in per cent, switches per switched row (0 where there are none)."""
    sums = result.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("n_switches") > 0).alias("switched_rows"), F.coalesce(F.sum("n_switches"), F.lit(0)).cast("bigint").alias("switches"))
    rate = F.when(F.col("total_rows") > 0, F.round(100 * F.col("switched_rows") / F.col("total_rows"), 4)).otherwise(0.0)
    each = F.when(F.col("switched_rows") > 0, F.round(F.col("switches") / F.col("switched_rows"), 4)).otherwise(0.0)
    return sums.withColumns({"rate": rate, "per_switched_row": each})


def switched_in_row(text: str, table: dict[str, list[str]], probability: float, seed: int, row_key: str):
    """Column form of `switched` for streams: the lexicon is a small literal map, and no row meets another."""
    literal = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def one(t, i):
        found = F.try_element_at(literal, F.lower(t))
        key, pos = F.col(row_key).cast("string"), i.cast("string")
        hit = found.isNotNull() & (uniform(seed, key, pos) < probability)
        return F.when(hit, match_case(F.element_at(found, choice(F.size(found), seed, key, pos) + 1), t)).otherwise(t)

    return F.array_join(F.transform(tokens(F.col(text)), one), " ")
