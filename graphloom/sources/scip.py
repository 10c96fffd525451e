"""Definitions from a SCIP index, read by the protobuf wire format."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.signatures import is_definition

# Field numbers of the SCIP schema.
_DOCUMENTS, _PATH, _OCCURRENCES, _RANGE, _SYMBOL, _ROLES = 2, 1, 2, 1, 2, 3


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message: numbers, or the bytes of strings and messages."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def _numbers(value: int | bytes) -> list[int]:
    """A repeated number, packed or not."""
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        n, at = _varint(value, at)
        out.append(n)
    return out


def occurrences(index: bytes) -> Iterator[tuple[str, str, int, int, int]]:
    """(symbol, file, first line, last line, roles); lines count from 1, a range of three numbers is on one line."""
    for number, document in fields(index):
        if number != _DOCUMENTS:
            continue
        parts = list(fields(document))
        file = next((v.decode() for n, v in parts if n == _PATH), "")
        for n, occurrence in parts:
            if n != _OCCURRENCES:
                continue
            place, symbol, roles = [], "", 0
            for k, v in fields(occurrence):
                if k == _RANGE:
                    place += _numbers(v)
                elif k == _SYMBOL:
                    symbol = v.decode()
                elif k == _ROLES:
                    roles = v
            if place:
                yield symbol, file, place[0] + 1, (place[2] if len(place) == 4 else place[0]) + 1, roles


def definitions(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, key, file, line_start, line_end) of the definitions of an index; key: package/Class#method."""
    raw = spark.read.format("binaryFile").load(path).select("content")

    def scan(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = list(occurrences(data))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) for c in zip(*rows, strict=True)],
                        ["symbol", "file", "line_start", "line_end", "roles"],
                    )

    rows = raw.mapInArrow(scan, "symbol string, file string, line_start long, line_end long, roles long")
    return rows.where(is_definition(F.col("roles"))).select(
        "symbol", symbol_key(F.col("symbol")).alias("key"), "file", "line_start", "line_end",
    )


def symbol_key(symbol):
    """The part of a symbol that names a method, package/Class#method, which an index equi-joins on; empty for others."""
    return F.regexp_extract(symbol, r"([\w$/]+#[^#(). ]+)\(\)\.", 1)
