"""Deeply nested records as related flat tables with content identities.

Every object gets the hash of its canonical content, in which nested objects stand as their own hashes (a Merkle tree): equal subtrees have
equal identities, an object's body is stored once, and each place where it stands is a bridge row from parent to child with its ordinal."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from json.decoder import scanstring
from json.encoder import encode_basestring_ascii as quoted

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys under which a lone object is a list of one and JSON text in a string is read as what it holds.
LIST_KEYS: tuple[str, ...] = ("topics", "narratives", "points", "history", "changes")
#: Keys of records that may be held as JSON text in a string.
RECORD_KEYS: tuple[str, ...] = ("meta", "by")
#: Characters of rows that a task gathers before it hands them on.
FLUSH_CHARS = 8_000_000
_SCHEMA = pa.schema(
    [
        ("row_no", pa.int64()),
        ("record_key", pa.string()),
        ("node_path", pa.string()),
        ("parent_path", pa.string()),
        ("list_key", pa.string()),
        ("ordinal", pa.int32()),
        ("in_list", pa.bool_()),
        ("node_hash", pa.string()),
        ("parent_hash", pa.string()),
        ("body", pa.string()),
    ]
)
_COLUMNS = "row_no bigint, record_key string, node_path string, parent_path string, list_key string, ordinal int, in_list boolean, node_hash string, parent_hash string, body string"


class Number(str):
    """A JSON number as text in one form for each value, of any size and precision."""

    __slots__ = ()


_PARTS = re.compile(r"(-?)(\d+)(?:\.(\d+))?(?:[eE]([+-]?\d+))?")


def number(text: str) -> Number:
    """Whole numbers without exponent, others with as few digits as they need: 1.50 and 15e-1 are 1.5, -0.0 is 0."""
    if text.isdigit():
        return Number(text)
    sign, whole, part, power = _PARTS.fullmatch(text).groups(default="")
    digits = (whole + part).lstrip("0")
    short = digits.rstrip("0")
    if not short:
        return Number("0")
    if len(power) > 1000:
        return Number(text.lower())
    shift = int(power or 0) - len(part) + len(digits) - len(short)
    if 0 <= shift <= 40:
        return Number(sign + short + "0" * shift)
    if -40 <= shift < 0:
        short = short.rjust(1 - shift, "0")
        return Number(f"{sign}{short[:shift]}.{short[shift:]}")
    return Number(f"{sign}{short}e{shift}")


def _no_constant(text: str) -> None:
    raise ValueError(text)


_DECODER = json.JSONDecoder(parse_constant=_no_constant, parse_int=number, parse_float=number)
_TOKEN = re.compile(r'[ \t\r\n]*(?:([{}\[\],:"])|(true|false|null)|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?))', re.ASCII)
_WORDS = {"true": True, "false": False, "null": None}


def _parse_deep(text: str) -> object:
    """As the standard decoder, with a stack of its own, so that any depth can be read; only for text that is too deep for that one."""
    open_: list[tuple[list | dict, str | None]] = []
    inside: list | dict | None = None
    key: str | None = None
    at, wants_value, may_end = 0, True, False
    while True:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        at, sign = m.end(), m[1]
        if wants_value and not (may_end and sign in ("]", "}")):
            if isinstance(inside, dict):
                if sign != '"':
                    raise ValueError(f"no key at {at}")
                key, at = scanstring(text, at)
                if not (m := _TOKEN.match(text, at)) or m[1] != ":":
                    raise ValueError(f"no colon at {at}")
                m = _TOKEN.match(text, m.end())
                if not m:
                    raise ValueError(f"no JSON at {at}")
                at, sign = m.end(), m[1]
            if sign in ("{", "["):
                value: object = {} if sign == "{" else []
            elif sign == '"':
                value, at = scanstring(text, at)
            elif sign:
                raise ValueError(f"no value at {at}")
            else:
                value = _WORDS[m[2]] if m[2] else number(m[3])
            if isinstance(inside, dict):
                inside[key] = value
            elif inside is not None:
                inside.append(value)
            if sign in ("{", "["):
                open_.append((inside, key))
                inside, wants_value, may_end = value, True, True
                continue
            if inside is None:
                break
        elif sign in ("]", "}"):
            if isinstance(inside, dict) != (sign == "}"):
                raise ValueError(f"wrong end at {at}")
            value = inside
            inside, key = open_.pop()
            if inside is None:
                break
        elif sign != "," or inside is None:
            raise ValueError(f"no comma at {at}")
        else:
            wants_value, may_end = True, False
            continue
        wants_value = may_end = False
    if text[at:].strip(" \t\r\n"):
        raise ValueError("text after the value")
    return value


def parse_json(text: str) -> object:
    """The value of RFC 8259 JSON text of any depth, numbers as Number; ValueError for all else."""
    start = text.lstrip(" \t\r\n")
    try:
        value, end = _DECODER.raw_decode(start)
    except RecursionError:
        return _parse_deep(start)
    if start[end:].strip(" \t\r\n"):
        raise ValueError("text after the value")
    return value


def _opened(value: object) -> object:
    """What JSON text in a string holds, if it is an object or a list; else the value itself."""
    while isinstance(value, str) and value.lstrip(" \t\r\n")[:1] in ("{", "[", '"'):
        try:
            value = parse_json(value)
        except ValueError:
            break
    return value


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def _scalar(value: object) -> str:
    if isinstance(value, Number):
        return value
    return quoted(value) if isinstance(value, str) else "null" if value is None else "true" if value else "false"


class _Frame:
    """An object or list whose members are being read. A list writes into the text of the object around it."""

    __slots__ = ("rest", "out", "comma", "key", "ordinal", "in_list", "owner", "depth", "rows")

    def __init__(self, value: dict | list, owner: _Frame | None, key: str | None, ordinal: int | None, in_list: bool, depth: int) -> None:
        self.key, self.ordinal, self.in_list, self.owner, self.depth, self.comma = key, ordinal, in_list, owner, depth, ""
        if isinstance(value, dict):
            self.rest, self.out, self.rows = iter(sorted(value.items())), [], []
        else:
            self.rest, self.out, self.rows = iter(enumerate(value)), owner.out, None


def nodes_of(record: object, lone: bool = True, list_keys: tuple[str, ...] = LIST_KEYS, record_keys: tuple[str, ...] = RECORD_KEYS) -> Iterator[list]:
    """All objects of a record, itself last, as [path, parent path, key, ordinal, in a list, hash, parent's hash, body]; none if it is no object.

    The walk holds the open objects and their children's rows only, so depth is bounded by memory alone.
    """
    record = _opened(record) if lone else record
    if not isinstance(record, dict):
        return
    names: list[str] = []
    frames = [_Frame(record, None, None, None, False, 0)]
    while frames:
        f = frames[-1]
        for name, value in f.rest:
            if f.rows is not None:
                f.out.append(f"{f.comma}{quoted(name)}:")
                if lone and name in list_keys:
                    value = _opened(value)
                    if isinstance(value, dict):
                        value = [value]
                elif lone and name in record_keys and isinstance(held := _opened(value), dict):
                    value = held
                key, ordinal, owner = name, None, f
            else:
                if f.comma:
                    f.out.append(",")
                if lone and isinstance(value, str) and f.key in list_keys and isinstance(held := _opened(value), dict):
                    value = held
                key, ordinal, owner = f.key, name, f.owner
            f.comma = ","
            if isinstance(value, (dict, list)):
                names.append(str(name))
                if isinstance(value, list):
                    f.out.append("[")
                frames.append(_Frame(value, owner, key, ordinal, f.rows is None, len(names)))
                break
            f.out.append(_scalar(value))
        else:
            frames.pop()
            if f.rows is None:
                f.out.append("]")
            else:
                body = "{" + "".join(f.out) + "}"
                own = _digest(body)
                for row in f.rows:
                    row[6] = own
                    yield row
                if f.owner is None:
                    yield ["", None, None, None, False, own, None, body]
                else:
                    f.owner.rows.append(["/".join(names), "/".join(names[: f.owner.depth]), f.key, f.ordinal, f.in_list, own, None, body])
                    f.owner.out.append(f'{{"$":"{own}"}}')
            if names:
                names.pop()


def _flatten(lone: bool, record_key: str, list_keys: tuple[str, ...], record_keys: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        size = 0
        for batch in batches:
            for row_no, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                try:
                    record = parse_json(text)
                except ValueError:
                    continue
                record = _opened(record) if lone else record
                own = record.get(record_key) if isinstance(record, dict) else None
                own = own if own is None or isinstance(own, str) else _scalar(own) if isinstance(own, bool) else None
                for node in nodes_of(record, lone, list_keys, record_keys):
                    rows.append([row_no, own, *node])
                    size += len(node[0]) + len(node[7]) + 200
                    if size > FLUSH_CHARS:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    try:
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _SCHEMA.types, strict=True)], schema=_SCHEMA)
    except UnicodeEncodeError:  # half of a surrogate pair in a key: shown as its escape
        plain = [[x.encode("utf-8", "backslashreplace").decode() if isinstance(x, str) else x for x in c] for c in columns]
        return pa.record_batch([pa.array(c, t) for c, t in zip(plain, _SCHEMA.types, strict=True)], schema=_SCHEMA)


def flatten_records(
    records: DataFrame,
    row_no: str,
    payload: str,
    lone: bool = True,
    tab_name: str = "",
    record_key: str = "topic_id",
    list_keys: tuple[str, ...] = LIST_KEYS,
    record_keys: tuple[str, ...] = RECORD_KEYS,
) -> DataFrame:
    """One row per object of each record: (tab_name, row_no, record_key, node_path, parent_path, list_key, ordinal, in_list, node_hash, parent_hash, body).

    `payload` is JSON text of any depth. Null payloads, text that is no RFC 8259 JSON or no object give no rows; null elements and elements
    that are no objects keep their positions. With `lone`, a lone object under one of `list_keys` is a list of one and JSON text in a string
    there, or under one of `record_keys`, is read as what it holds. record_key is the root's scalar member of that name. Numbers of one value
    are one, whatever their spelling and precision; of members of the same name the last counts. Repeated records give repeated occurrences
    under the same identities; (tab_name, row_no, node_path) is unique if row_no is. Half of a surrogate pair in a key stands as its escape.
    Narrow: no shuffle.
    """
    rows = records.select(F.col(row_no).cast("bigint"), F.col(payload).cast("string"))
    return rows.mapInArrow(_flatten(lone, record_key, list_keys, record_keys), _COLUMNS).select(F.lit(tab_name).alias("tab_name"), "*")


def flatten_topics(topics: DataFrame, tab_name: str = "topics") -> DataFrame:
    """As flatten_records, for the typed column topics; null fields of its structs are absent members."""
    record = F.struct("topic_id", "topics")
    text = F.to_json(record, {"ignoreNullFields": "true"})
    return flatten_records(topics.select("row_no", text.alias("payload")), "row_no", "payload", lone=False, tab_name=tab_name)


def objects(nodes: DataFrame) -> DataFrame:
    """Each different object once: (node_hash, body); in the body nested objects stand as their hashes. Partial aggregation precedes the shuffle."""
    return nodes.groupBy("node_hash").agg(F.min("body").alias("body"))


def bridge(nodes: DataFrame) -> DataFrame:
    """Each occurrence of an object: (tab_name, row_no, record_key, node_path, parent_path, parent_hash, node_hash, list_key, ordinal)."""
    return nodes.select("tab_name", "row_no", "record_key", "node_path", "parent_path", "parent_hash", "node_hash", "list_key", "ordinal")


def member(name: str) -> Column:
    """The identity of the object that stands under a member of a body."""
    return F.get_json_object("body", f"$.{name}['$']")


def level(nodes: DataFrame, key: str, fields: str) -> DataFrame:
    """The flat table of one level: the objects in lists under `key`, with the link to their parent and typed columns.

    (tab_name, row_no, record_key, node_path, parent_path, parent_hash, node_hash, ordinal, fields...); `fields` is a schema string of
    scalar members. A missing member, or one that does not have the type, is null.
    """
    own = nodes.where(F.col("in_list") & (F.col("list_key") == key)).withColumn("_f", F.from_json("body", fields))
    return own.select("tab_name", "row_no", "record_key", "node_path", "parent_path", "parent_hash", "node_hash", "ordinal", "_f.*", "body")
