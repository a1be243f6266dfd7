"""Loading delimited records strictly, with the ones that do not parse set apart.

A record is parsed by Python's csv reader in strict mode inside mapPartitions-style batches. Structural
errors are captured first (quoting, then the number of columns), typed constructors run only on records
of the right shape. Values never appear in a reason, only its name.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.sources.quoted_scan import scan_records

QUOTING, COLUMN_COUNT, BAD_DATE, BAD_AMOUNT, BAD_BALANCE = "quoting", "column_count", "bad_date", "bad_amount", "bad_balance"

_STAMP = re.compile(r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", re.ASCII)
_NUMBER = re.compile(r"(?:\d+(?:\.\d{0,2})?|\.\d{1,2})", re.ASCII)


@dataclass(frozen=True)
class ExportLayout:
    """Columns of an export by position, and where the typed ones are."""

    columns: int = 10
    date: int = 2
    description: int = 4
    amount: int = 5
    currency: int = 7
    balance: int = 9


class FieldError(ValueError):
    """A record that is well formed but holds a value its type refuses; carries the reason's name only."""


def money(text: str) -> Decimal | None:
    """A number of the plain money grammar; None where blank or "-"; FieldError where it is neither.

    Surrounding blanks go, "(x)" is minus x, blanks inside go, one "+" in front goes; digits 0-9 with at
    most two decimals.
    """
    s = text.strip()
    if s in ("", "-"):
        return None
    negative = len(s) > 1 and s[0] == "(" and s[-1] == ")"
    if negative:
        s = s[1:-1].strip()
    s = s.replace(" ", "")
    s = s.removeprefix("+")
    sign = s[:1]
    if sign and sign in "+-":
        s = s[1:]
    if not _NUMBER.fullmatch(s):
        raise FieldError
    value = Decimal(s if s[-1] != "." else s[:-1])
    return -value if negative != (sign == "-") else value


def stamp(text: str) -> datetime | None:
    """A real time yyyy-MM-dd HH:mm:ss in full; None where blank."""
    if not text.strip():
        return None
    s = text.strip()
    if not _STAMP.fullmatch(s):
        raise FieldError
    try:
        return datetime(*map(int, re.split(r"[- :]", s)))
    except ValueError:
        raise FieldError from None


def _placeholders(raw: str) -> list[str]:
    """Two characters that raw doesn't hold, to stand for line breaks while the csv reader runs."""
    found = (chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in raw)
    return [next(found), next(found)]


def split_record(raw: str) -> list[str] | None:
    """The fields of one record, None where its quoting is broken.

    One carriage return at the end is no part of the record. Line breaks inside a field are kept, quoted or not.
    """
    if raw.endswith("\r"):
        raw = raw[:-1]
    marks = None
    if "\n" in raw or "\r" in raw:
        marks = _placeholders(raw)
        raw = raw.replace("\n", marks[0]).replace("\r", marks[1])
    try:
        fields = next(csv.reader([raw], strict=True), [])
    except csv.Error:
        return None
    if marks:
        fields = [f.replace(marks[0], "\n").replace(marks[1], "\r") for f in fields]
    return fields


def parse_record(raw: str, layout: ExportLayout) -> tuple[str | None, list[str] | None, datetime | None, Decimal | None, Decimal | None]:
    """(reason, fields, date, amount, balance); the first reason that applies."""
    fields = split_record(raw)
    if fields is None:
        return QUOTING, None, None, None, None
    if len(fields) != layout.columns:
        return COLUMN_COUNT, None, None, None, None
    try:
        reason = BAD_DATE
        date = stamp(fields[layout.date])
        reason = BAD_AMOUNT
        amount = money(fields[layout.amount])
        if amount is None:
            raise FieldError
        reason = BAD_BALANCE
        balance = money(fields[layout.balance])
    except FieldError:
        return reason, None, None, None, None
    return None, fields, date, amount, balance


PARSED = T.StructType(
    [
        T.StructField("line_id", T.LongType()),
        T.StructField("reason", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("date", T.DateType()),
        T.StructField("description", T.StringType()),
        T.StructField("amount", T.DecimalType(38, 2)),
        T.StructField("balance", T.DecimalType(38, 2)),
        T.StructField("currency", T.StringType()),
    ]
)


#: Digits that an amount may have for its type to hold it.
DIGITS = 38


def _fitting(value: Decimal | None) -> Decimal | None:
    return value if value is None or len(str(abs(int(value)))) <= DIGITS - 2 else None


def parse_records(lines: DataFrame, layout: ExportLayout = ExportLayout()) -> DataFrame:
    """One row per record of lines (line_id, source_file, line_no, raw): its reason, or its typed fields.

    Headers (line_no 1) and empty records (null or without any character but a carriage return) are no
    records. A null line_no is taken as a record. Extra columns are ignored, repeated rows stay repeated, an
    empty table gives an empty table, texts of any length are parsed whole. A number of more than 36 digits before
    the point is a number, so its record parses, but no type holds it: its cell is null. Map-only: nothing is shuffled.
    """
    arrow = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.date32(), pa.string(), pa.decimal128(38, 2), pa.decimal128(38, 2), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            ids, files, numbers, raws = (batch.column(i).to_pylist() for i in range(4))
            out: list[list] = [[] for _ in arrow]
            for line_id, file, number, raw in zip(ids, files, numbers, raws):
                reason, fields, date, amount, balance = parse_record(raw, layout)
                row = (line_id, reason, file, number and number - 1, date and date.date(), fields and fields[layout.description].strip(), _fitting(amount), _fitting(balance), (fields and fields[layout.currency].strip()) or None)
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, arrow)], names=PARSED.names)

    records = lines.filter(
        (F.col("line_no").isNull() | (F.col("line_no") != 1)) & F.col("raw").isNotNull() & (F.regexp_replace("raw", r"[\r\n]", "") != "")
    ).select(F.col("line_id").cast("long"), F.col("source_file").cast("string"), F.col("line_no").cast("int"), F.col("raw").cast("string"))
    return records.mapInArrow(run, PARSED)


def rejected(parsed: DataFrame) -> DataFrame:
    """(line_id, reason) of the records that do not parse."""
    return parsed.filter(F.col("reason").isNotNull()).select("line_id", "reason")


def accepted(parsed: DataFrame) -> DataFrame:
    """Canonical rows of the records that parse."""
    return parsed.filter(F.col("reason").isNull()).drop("reason")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of text files in the columns parse_records() takes: assembled over line breaks, files split at will.

    line_no is that of the record's first line, line_id the number of the record in its file.
    """
    found = scan_records(spark, path)
    return found.select(F.col("record").alias("line_id"), "source_file", F.col("line").cast("int").alias("line_no"), "raw")
