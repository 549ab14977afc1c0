"""Judgment lines: sound lines become judgment rows, the others come out apart with their reasons."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("query_id", "iter", "doc_id", "relevance")
DOC_ID, RELEVANCE = r"^[A-Z]{2}[0-9]{6}-[0-9]{4,}$", r"^(-0*1|-?0+|0*[123])$"
#: Most lines of one first block.
BLOCK_LINES = 4096
#: Lines from which a failing block is no longer halved but read strictly, line by line.
STRICT_LINES = 16
_READ = pacsv.ReadOptions(column_names=list(COLUMNS), use_threads=False)
_PARSE = pacsv.ParseOptions(delimiter=" ", quote_char=False, newlines_in_values=False, ignore_empty_lines=False)
_TYPES = pacsv.ConvertOptions(column_types=dict.fromkeys(COLUMNS, pa.string()), strings_can_be_null=False)
_SCHEMA = pa.schema([("line_no", pa.int64()), *((c, pa.string()) for c in COLUMNS), ("reasons", pa.list_(pa.string()))])


class Block:
    """Lines made ready once for columnar parsing of any part of them: evened blanks, and whether a line may be parsed so at all."""

    def __init__(self, lines: pa.Array) -> None:
        self.lines = lines
        odd = pc.fill_null(pc.match_substring_regex(lines, r'["\n\x00]|\r.'), True)
        self.plain = ~odd.to_numpy(zero_copy_only=False)
        self.even = [x or "" for x in pc.replace_substring_regex(pc.utf8_trim(lines, " \t\r"), r"[ \t]+", " ").to_pylist()]

    def parse(self, start: int, end: int) -> pa.Table | None:
        """The four columns of the lines if all of them are sound and unquoted, else None: one columnar parse, no work per line."""
        if not self.plain[start:end].all():
            return None
        try:
            got = pacsv.read_csv(io.BytesIO("\n".join(self.even[start:end]).encode()), _READ, _PARSE, _TYPES)
        except pa.ArrowInvalid:
            return None
        sound = got.num_rows == end - start and pc.all(pc.match_substring_regex(got["doc_id"], DOC_ID)).as_py() and pc.all(pc.match_substring_regex(got["relevance"], RELEVANCE)).as_py()
        return got if sound else None


_FIELD = re.compile(r'[ \t]*(?:"((?:[^"]|"")*)"|([^" \t]+))(?=[ \t]|$)')
_DOC, _REL = re.compile(DOC_ID, re.ASCII), re.compile(RELEVANCE, re.ASCII)


def diagnose(line: str | None) -> tuple[list[str | None], list[str]]:
    """Strict reading of one line: its four fields (nulls where it has not four) and the reasons against it, none if it is sound.

    A null line has no fields, as a blank one. `quoting` and `column_count` stand alone; `doc_id` and `relevance` may come together.
    """
    none: list[str | None] = [None] * 4
    rest = (line or "").removesuffix("\r").strip(" \t")
    fields, at = [], 0
    while at < len(rest):
        m = _FIELD.match(rest, at)
        if not m:
            return none, ["quoting"]
        fields.append(m[2] if m[1] is None else m[1].replace('""', '"'))
        at = m.end()
    if len(fields) != 4:
        return none, ["column_count"]
    return fields, [name for name, rule, x in (("doc_id", _DOC, fields[2]), ("relevance", _REL, fields[3])) if not rule.search(x) or x.endswith("\n")]


def _isolate(line_no: pa.Array, block: Block, start: int, end: int) -> Iterator[pa.Table]:
    """Blocks that parse come out whole; a failing one is halved until few lines are left, which are read strictly."""
    got = block.parse(start, end) if end - start > STRICT_LINES or block.plain[start:end].all() else None
    if got is not None:
        yield pa.table([line_no[start:end], *got.columns, pa.nulls(end - start, _SCHEMA.field("reasons").type)], schema=_SCHEMA)
    elif end - start <= STRICT_LINES:
        rows = [diagnose(x) for x in block.lines[start:end].to_pylist()]
        yield pa.table([line_no[start:end], *(pa.array([r[0][i] for r in rows], pa.string()) for i in range(4)), pa.array([r[1] or None for r in rows], _SCHEMA.field("reasons").type)], schema=_SCHEMA)
    else:
        half = (start + end) // 2
        yield from _isolate(line_no, block, start, half)
        yield from _isolate(line_no, block, half, end)


def _first_size(lines: int, bad: int) -> int:
    """Lines of the next block before any halving: as many as hold two bad lines at the share seen so far, so that a file of
    many bad lines isn't parsed at every size, and one of few is parsed in long blocks."""
    wanted = BLOCK_LINES if not bad else 2 * lines // bad
    return max(2 * STRICT_LINES, min(BLOCK_LINES, 1 << (max(1, wanted).bit_length() - 1)))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lines = bad = 0
    for batch in batches:
        line_no, block = batch.column(0).cast(pa.int64()), Block(batch.column(1).cast(pa.string()))
        at, found = 0, []
        while at < batch.num_rows:
            end = min(batch.num_rows, at + _first_size(lines, bad))
            parts = list(_isolate(line_no, block, at, end))
            lines, bad = lines + end - at, bad + sum(len(t) - t["reasons"].null_count for t in parts)
            found += parts
            at = end
        if found:
            yield from pa.concat_tables(found).combine_chunks().to_batches()


def parse_lines(lines: DataFrame, line_no: str = "line_no", raw: str = "raw_line") -> DataFrame:
    """All lines as (line_no, query_id, iter, doc_id, relevance, reasons); reasons is null for sound lines.

    Narrow: no shuffle. Null and blank lines have no fields (`column_count`), repeated lines count each, other columns are not read.
    An empty table gives no rows.
    """
    return lines.select(F.col(line_no).cast("bigint"), F.col(raw)).mapInArrow(_parse, "line_no bigint, query_id string, iter string, doc_id string, relevance string, reasons array<string>")


def sound_lines(parsed: DataFrame) -> DataFrame:
    """Judgment rows of the sound lines, relevance as an integer."""
    return parsed.where("reasons is null").select("line_no", "query_id", "iter", "doc_id", F.col("relevance").cast("int").alias("relevance"))


def rejected_lines(parsed: DataFrame) -> DataFrame:
    """One row per bad line and reason."""
    return parsed.where("reasons is not null").select("line_no", F.explode("reasons").alias("reason"))
