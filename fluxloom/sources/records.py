"""Records from JSON, MessagePack, libsvm lines and CSV as datum entries in long form."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = "array<struct<path:string,s:string,n:double>>"


def _walk(value: object, path: str, null: str, out: list) -> None:
    if isinstance(value, dict):
        for k, v in value.items():
            _walk(v, f"{path}/{k}", null, out)
    elif isinstance(value, list):
        for k, v in enumerate(value):
            _walk(v, f"{path}[{k}]", null, out)
    elif value is None:
        out.append((path, null, None))
    elif isinstance(value, (bool, int, float)):
        out.append((path, None, float(value)))
    elif isinstance(value, (bytes, str)):
        out.append((path, value.decode("utf-8", "replace") if isinstance(value, bytes) else value, None))


def flatten(value: object, null: str = "null") -> list[tuple]:
    out: list[tuple] = []
    _walk(value, "", null, out)
    return out


def from_json(df: DataFrame, row_id: str, column: str) -> DataFrame:
    """row_id, key, string_value, num_value for any depth of JSON; booleans are 1 and 0, null the string 'null'."""

    @F.pandas_udf(ENTRY)
    def entries(texts: pd.Series) -> pd.Series:
        return pd.Series([flatten(json.loads(t)) if t is not None else [] for t in texts])

    return df.select(F.col(row_id).alias("row_id"), F.explode(entries(column)).alias("e")).select("row_id", F.col("e.path").alias("key"), F.col("e.s").alias("string_value"), F.col("e.n").alias("num_value"))


def from_flat_json(df: DataFrame, row_id: str, column: str) -> DataFrame:
    """As from_json() for objects of numbers, within the JVM."""
    return df.select(F.col(row_id).alias("row_id"), F.explode(F.from_json(column, "map<string,double>")).alias("key", "num_value")).select("row_id", F.concat(F.lit("/"), "key").alias("key"), F.lit(None).cast("string").alias("string_value"), "num_value")


def unpack(data: bytes, at: int = 0) -> tuple[object, int]:
    """One MessagePack value and where it ends; extension types are None."""
    b, at = data[at], at + 1
    take = lambda fmt, at: (struct.unpack_from(fmt, data, at)[0], at + struct.calcsize(fmt))

    def some(n: int, at: int, pairs: bool) -> tuple[object, int]:
        out: list = []
        for _ in range(2 * n if pairs else n):
            v, at = unpack(data, at)
            out.append(v)
        text = lambda k: k.decode("utf-8", "replace") if isinstance(k, bytes) else k
        return ({text(k): v for k, v in zip(out[::2], out[1::2])} if pairs else out), at

    if b < 0x80:
        return b, at
    if b < 0x90:
        return some(b & 15, at, True)
    if b < 0xA0:
        return some(b & 15, at, False)
    if b < 0xC0:
        return data[at : at + (b & 31)], at + (b & 31)
    if b >= 0xE0:
        return b - 256, at
    if b in (0xC0, 0xC1):
        return None, at
    if b in (0xC2, 0xC3):
        return b == 0xC3, at
    numbers = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
    if b in numbers:
        return take(numbers[b], at)
    raw = {0xC4: ">B", 0xC5: ">H", 0xC6: ">I", 0xD9: ">B", 0xDA: ">H", 0xDB: ">I"}
    if b in raw:
        n, at = take(raw[b], at)
        return data[at : at + n], at + n
    if 0xDC <= b <= 0xDF:
        n, at = take(">H" if b in (0xDC, 0xDE) else ">I", at)
        return some(n, at, b >= 0xDE)
    n = {0xD4: 1, 0xD5: 2, 0xD6: 4, 0xD7: 8, 0xD8: 16}.get(b)
    if n is None:
        n, at = take({0xC7: ">B", 0xC8: ">H", 0xC9: ">I"}[b], at)
    return None, at + 1 + n


def from_msgpack(df: DataFrame, row_id: str, column: str) -> DataFrame:
    """As from_json() from MessagePack; nil is the string 'NULL'."""

    @F.pandas_udf(ENTRY)
    def entries(blobs: pd.Series) -> pd.Series:
        return pd.Series([flatten(unpack(bytes(b))[0], "NULL") if b is not None else [] for b in blobs])

    return df.select(F.col(row_id).alias("row_id"), F.explode(entries(column)).alias("e")).select("row_id", F.col("e.path").alias("key"), F.col("e.s").alias("string_value"), F.col("e.n").alias("num_value"))


def from_libsvm(df: DataFrame, row_id: str, line: str) -> DataFrame:
    """row_id, label, key, num_value of lines 'label id:value ...'; a pair without a colon is an error."""
    parts = F.filter(F.split(F.trim(line), "\\s+"), lambda t: t != "")
    pairs = F.slice(parts, 2, F.size(parts))
    rows = df.select(F.col(row_id).alias("row_id"), parts[0].alias("label"), F.explode(pairs).alias("p"))
    bad = F.raise_error(F.concat(F.lit("not id:value: "), "p"))
    return rows.select("row_id", "label", F.when(F.instr("p", ":") > 0, F.substring_index("p", ":", 1)).otherwise(bad).alias("key"), F.substring_index("p", ":", -1).cast("double").alias("num_value"))


def csv_fields(line: Column, n: int) -> Column:
    """The fields of one CSV line as a struct of strings c0, c1, ..."""
    return F.from_csv(line, ", ".join(f"c{k} string" for k in range(n)))


def html_encode(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html_element(name: str, attributes: dict[str, Column], *children: Column) -> Column:
    """Markup of one element: attributes in order of their names, empty ones without a value; an element without children
    closes itself. Children are markup: other elements, or encoded text."""
    encoded = html_encode(F.lit(name))
    given = [F.concat(F.lit(" "), html_encode(F.lit(k)), F.when(v == "", "").otherwise(F.concat(F.lit('="'), html_encode(v), F.lit('"')))) for k, v in sorted(attributes.items())]
    if not children:
        return F.concat(F.lit("<"), encoded, *given, F.lit(" />"))
    return F.concat(F.lit("<"), encoded, *given, F.lit(">"), *children, F.lit("</"), encoded, F.lit(">"))
