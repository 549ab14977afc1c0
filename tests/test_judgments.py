import random
import re

import pyarrow as pa

from babelframe.sources import judgments as J


def plain(line):
    """A reading of the rule by hand, character by character."""
    s = re.sub(r"\r$", "", line or "").strip(" \t")
    fields, i = [], 0
    while i < len(s):
        while i < len(s) and s[i] in " \t":
            i += 1
        if s[i] == '"':
            j, out = i + 1, ""
            while True:
                if j >= len(s):
                    return ["quoting"]
                if s[j] == '"':
                    if s[j : j + 2] == '""':
                        out, j = out + '"', j + 2
                        continue
                    break
                out, j = out + s[j], j + 1
            j += 1
            if j < len(s) and s[j] not in " \t":
                return ["quoting"]
        else:
            j = i
            while j < len(s) and s[j] not in " \t":
                if s[j] == '"':
                    return ["quoting"]
                j += 1
            out = s[i:j]
        fields.append(out)
        i = j
    if len(fields) != 4:
        return ["column_count"]
    bad = []
    if not re.fullmatch(r"[A-Z]{2}[0-9]{6}-[0-9]{4,}", fields[2]):
        bad.append("doc_id")
    if not (re.fullmatch(r"-?[0-9]+", fields[3]) and -1 <= int(fields[3]) <= 3):
        bad.append("relevance")
    return bad


SOUND = ["T1 0 LA000101-1234 1", "  T1\t0  LA000101-1234\t-1 \t", "T1 0 LA000101-12345 0003\r", '"T 1" "a ""b""" "LA000101-1234" "0"', "T1 0 LA000101-1234 -01", "T1 0 LA000101-1234 -0"]
BAD = {None: ["column_count"], "": ["column_count"], "\t": ["column_count"], "a b c": ["column_count"], 'T1 0 "LA000101-1234"x 1': ["quoting"], 'T1 0 LA"000101-1234 1': ["quoting"], 'T1 "0 LA000101-1234 1': ["quoting"], "T1 0 la000101-1234 4": ["doc_id", "relevance"], "T1 0 LA000101-1234 +1": ["relevance"], "T1 0 LA000101-1234 ٣": ["relevance"], 'T1 0 "" 1': ["doc_id"], "T1 0 LA000101-1234\n 1": ["doc_id"], 'T1 0 ""LA000101-1234"" 1': ["quoting"], "T1 0 LA000101-1234 1\r\r": ["relevance"]}


def test_diagnosis():
    for line in SOUND:
        assert J.diagnose(line)[1] == [], line
    for line, reasons in BAD.items():
        assert J.diagnose(line)[1] == reasons, line
    assert J.diagnose(SOUND[3])[0] == ["T 1", 'a "b"', "LA000101-1234", "0"]


def test_random_lines_against_plain_reading():
    rng = random.Random(7)
    for _ in range(5000):
        line = "".join(rng.choice(['"', " ", "\t", "a", '""', "LA000101-1234", " 1", "0 ", "T "]) for _ in range(rng.randint(0, 9)))
        assert J.diagnose(line)[1] == plain(line), line


def test_blocks_agree_with_single_lines():
    lines = pa.array(SOUND * 3 + list(BAD) + SOUND)
    got = pa.concat_tables(J._isolate(pa.array(range(len(lines))), J.Block(lines), 0, len(lines))).to_pylist()
    assert [r["line_no"] for r in got] == list(range(len(lines)))
    assert [r["reasons"] or [] for r in got] == [J.diagnose(x)[1] for x in lines.to_pylist()]
    assert J.Block(pa.array(["T1 0 LA000101-1234 1", "T1\t\t0 LA000101-1234 1 \r"])).parse(0, 2).num_rows == 2


def test_tables(spark, rows_of):
    rows = [(i, "f", x, "extra") for i, x in enumerate([*SOUND, *BAD])]
    df = spark.createDataFrame(rows, "line_no bigint, file_name string, raw_line string, reasons string")
    parsed = J.parse_lines(df)
    assert J.sound_lines(parsed).count() == len(SOUND)
    assert rows_of(J.rejected_lines(parsed)) == sorted((i + len(SOUND), r) for i, x in enumerate(BAD.values()) for r in x)
    assert J.parse_lines(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "f", "T1 0 LA000101-1234 1 " + "x" * 2_000_000)], "line_no bigint, file_name string, raw_line string")
    assert rows_of(J.rejected_lines(J.parse_lines(long))) == [(1, "column_count")]
