import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from babelframe.functions import text as T
from babelframe.functions.languages import iso3, name_of

SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0       　"
ODD = [None, "", " ", "a", "a  b", "　x y\n", "straße", "İx", "ÉCOLE École école", "😀 a"]


def texts(n=300):
    rng = random.Random(1)
    return ODD + ["".join(rng.choice(SPACES + "abÄß.!") for _ in range(rng.randint(0, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "i int, x string").cache()


def column(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_long_runs_of_white_space(spark):
    long = " a" + " \n" * 200_000 + "b\t " + " " * 1000
    got = spark.createDataFrame([(long,), (" " * 200_000,)], "x string").select(T.strip(F.col("x"))).collect()
    assert [r[0] for r in got] == [long.strip(), ""]


def test_white_space_as_in_python(df):
    want = texts()
    assert column(df, T.clean_text(F.col("x"))) == [None if t is None else re.sub(r"\s+", " ", t).strip() for t in want]
    assert column(df, T.strip(F.col("x"))) == [None if t is None else t.strip() for t in want]
    assert column(df, T.tokens(F.col("x"))) == [None if t is None else t.split() for t in want]
    assert column(df, T.drop_newlines(F.col("x"))) == [None if t is None else re.sub(r"[\n\r]", "", t) for t in want]
    assert column(df, T.document_hash(F.col("x"), F.col("x"))) == [hashlib.md5(((t or "").strip() * 2).encode()).hexdigest() for t in want]


def test_match_case(spark):
    rows = [("HOUSE", "maison verte", "MAISON VERTE"), ("House", "MAISON verte", "Maison verte"), ("house", "Maison", "Maison"), ("A", "un", "UN"), ("12", "x", "x"), ("", "x", "x"), ("élan", "x", "x"), ("Élan", "xY", "Xy")]
    got = spark.createDataFrame(rows, "s string, r string, w string").select(T.match_case(F.col("r"), F.col("s")).alias("g"), "w").collect()
    assert [r["g"] for r in got] == [r["w"] for r in got]


def test_small_functions(spark):
    row = spark.createDataFrame([("C041", "a title: b title: c", "One. Two!  Three? four")], "n string, t string, s string")
    got = row.select(T.topic_number(F.col("n")), T.topic_number(F.lit("x")), T.after_last(F.col("t"), "title:"), T.sentences(F.col("s")), T.terms(F.col("s"))).first()
    assert list(got) == [41, None, " c", ["One.", "Two!", "Three?", "four"], ["one", "two", "three", "four"]]
    codes = spark.createDataFrame([("de",), ("DEU",), ("german",), ("xx",), (None,)], "c string").select(iso3(F.col("c")), name_of(F.col("c"))).collect()
    assert [tuple(r) for r in codes] == [("deu", "german"), ("deu", "german"), ("deu", "german"), ("xx", "xx"), (None, None)]


def test_draws(spark):
    many = spark.range(4000).select(T.uniform(7, F.col("id").cast("string")).alias("u"), T.choice(F.lit(3), 7, F.col("id").cast("string")).alias("c"))
    mean, low, high = many.agg(F.avg("u"), F.min("c"), F.max("c")).first()
    assert abs(mean - 0.5) < 0.03 and (low, high) == (0, 2)
    assert many.repartition(7).agg(F.sum("u")).first()[0] == pytest.approx(many.agg(F.sum("u")).first()[0])
