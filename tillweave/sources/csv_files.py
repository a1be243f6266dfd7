"""Delimited files: exports by profile, and the engine's own ledgers, always read as text and then coerced."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tillweave.config.errors import ExtractionError, InputError
from tillweave.config.profile import Profile
from tillweave.config.strategies import EXTRACTORS
from tillweave.functions.columns import MONEY, parse_date, parse_flag, parse_money
from tillweave.sources.quoted_scan import first_record, scan_records

LEDGER = ("date", "description", "amount", "balance", "currency", "account", "source_file", "page", "row")
CHART_COLUMNS = ("date", "description", "amount", "balance", "account", "category", "subcategory", "is_transfer")
CATEGORISE_COLUMNS = ("description", "account", "amount")


def header_of(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8") -> list[str]:
    """The column names of a file; none where it is empty."""
    import csv

    first = first_record(spark, path, delimiter, encoding)
    return [] if first is None else next(csv.reader([first.removeprefix("\ufeff").rstrip("\r")], delimiter=delimiter), [])


def _cells(spark: SparkSession, path: str, names: Sequence[str], delimiter: str, encoding: str) -> DataFrame:
    """(source_file, file, record, cells): the records behind the header, cells by place; short records have null cells, surplus ones are dropped."""
    records = scan_records(spark, path, delimiter, encoding).filter("record > 1")
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "emptyValue": "", "maxCharsPerColumn": "-1"}
    # Files of a folder come in the order of their names; the driver knows them from planning the scan.
    files = sorted({unquote(f.rpartition("/")[2]) for f in spark.read.text(path).inputFiles()})
    if len(files) > 1:
        places = spark.createDataFrame(list(zip(files, range(len(files)))), "source_file string, file long")
        records = records.join(F.broadcast(places), "source_file")
    else:
        records = records.withColumn("file", F.lit(0).cast("long"))
    return records.select("source_file", "file", "record", F.from_csv(F.regexp_replace("raw", "\r$", ""), schema, options).alias("cells"))


def read_text_frame(spark: SparkSession, path: str, required: Sequence[str] = (), delimiter: str = ",", encoding: str = "utf-8") -> DataFrame:
    """All cells as text, absent ones as blank text, beside ord, the place of the row; InputError names missing columns."""
    names = header_of(spark, path, delimiter, encoding)
    if missing := [c for c in required if c not in names]:
        raise InputError(f"missing column(s): {', '.join(missing)}")
    cell = {n: F.coalesce(F.col(f"cells.c{i}"), F.lit("")).alias(n) for i, n in enumerate(names)}
    return _cells(spark, path, names, delimiter, encoding).select(*cell.values(), (F.shiftleft("file", 33) + F.col("record") - 2).alias("ord"))


def read_export(spark: SparkSession, path: str, profile: Profile) -> DataFrame:
    """Raw text rows of one export: the mapped columns by field, row numbered from 1, no page."""
    if profile.source != "csv":
        raise ExtractionError("the profile is not for delimited files")
    names = header_of(spark, path, profile.delimiter, profile.encoding)
    if not names:
        raise ExtractionError("the file has no header")
    if lost := sorted(set(profile.column_map) - set(names)):
        raise ExtractionError(f"the header lacks {', '.join(lost)}")
    place = {n: i for i, n in enumerate(names)}
    fields = [F.coalesce(F.col(f"cells.c{place[source]}"), F.lit("")).alias(field) for source, field in profile.column_map.items()]
    rows = _cells(spark, path, names, profile.delimiter, profile.encoding)
    return rows.select(*fields, "source_file", (F.col("record") - 1).cast("int").alias("row"), F.lit(None).cast("int").alias("page"))


def union_in_order(frames: list[DataFrame]) -> DataFrame:
    """Rows of several files in argument order, with ord built from file and row."""
    placed = [f.withColumn("ord", F.lit(i << 32) + F.col("row")) for i, f in enumerate(frames)]
    return reduce(DataFrame.unionByName, placed)


def typed_ledger(text: DataFrame) -> DataFrame:
    """A ledger of text cells as typed columns beside ord; InputError counts cells that can't be read."""
    present = lambda c: F.col(c) if c in text.columns else F.lit("")
    typed = text.withColumns(
        {
            "_date": parse_date(present("date"), "%Y-%m-%d"),
            "_amount": parse_money(F.col("amount"), ""),
            "_balance": parse_money(present("balance"), ""),
            "_flag": parse_flag(present("is_transfer")),
        }
    )
    blank = lambda c: F.trim(present(c)) == ""
    bad = {
        "date": F.col("_date").isNull() & ~blank("date"),
        "amount": F.col("_amount").isNull(),
        "balance": F.col("_balance").isNull() & ~blank("balance"),
        "is_transfer": F.col("_flag").isNull() if "is_transfer" in text.columns else F.lit(False),
    }
    counts = typed.agg(*(F.min(F.when(b, F.col("ord"))).alias(c) for c, b in bad.items()), *(F.count_if(b).alias(f"n_{c}") for c, b in bad.items())).first()
    for c in bad:
        if counts[f"n_{c}"]:
            raise InputError(f"column {c}: {counts[f'n_{c}']} cell(s) can't be read, the first in row {counts[c]}")
    out = typed.withColumns({"date": F.col("_date"), "amount": F.col("_amount").cast(MONEY), "balance": F.col("_balance"), "is_transfer": F.coalesce("_flag", F.lit(False))})
    return out.drop("_date", "_amount", "_balance", "_flag").withColumn("currency", present("currency"))


def ledger_text(rows: DataFrame) -> DataFrame:
    """Canonical rows as the text cells of the ledger file, in its column order."""
    cell = {
        "date": F.date_format("date", "yyyy-MM-dd"),
        "amount": F.col("amount").cast("string"),
        "balance": F.col("balance").cast("string"),
        "page": F.col("page").cast("string"),
        "row": F.col("row").cast("string"),
    }
    return rows.select(*(F.coalesce(cell.get(c, F.col(c)), F.lit("")).alias(c) for c in LEDGER), *(["ord"] if "ord" in rows.columns else []))


def write_single_csv(df: DataFrame, path: str, order: Sequence[str | F.Column] = ()) -> None:
    """One file in order, streamed through the driver row by row: for files people open."""
    import csv

    names = [c for c in df.columns if c != "ord"]
    ordered = df.orderBy(*order) if order else df
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out)
        writer.writerow(names)
        for r in ordered.select(names).toLocalIterator():
            writer.writerow(["" if v is None else v for v in r])


def write_csv(df: DataFrame, path: str, order: Sequence[str | F.Column] = ()) -> None:
    """A folder of files, each with the header, in order from file to file: for results of any size.

    Columns of the order that are no part of the result may be named ord; it is left out.
    """
    ordered = df.orderBy(*order) if order else df
    options = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    ordered.select([c for c in df.columns if c != "ord"]).write.mode("overwrite").options(**options).csv(path)


def write_rows(df: DataFrame, path: str, order: Sequence[str | F.Column] = ()) -> None:
    """A folder of files where path ends with a slash, else one file."""
    (write_csv if path.endswith("/") else write_single_csv)(df, path, order)


def write_ledger(rows: DataFrame, path: str) -> None:
    """The native form of a ledger: Parquet, by month, so that date ranges prune files."""
    rows.withColumn("month", F.date_format("date", "yyyy-MM")).write.mode("overwrite").partitionBy("month").parquet(path)


WORDS = T.StructType(
    [T.StructField(n, t) for n, t in (("source_file", T.StringType()), ("page", T.IntegerType()), ("page_width", T.DoubleType()), ("page_height", T.DoubleType()), ("flow_idx", T.IntegerType()), ("text", T.StringType()), ("x0", T.DoubleType()), ("x1", T.DoubleType()), ("top", T.DoubleType()))]
)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """A word table from Parquet or CSV, or from page files whose suffix has an extractor (see EXTRACTORS).

    An extractor gets the bytes of one file, on a worker, and yields rows of the word table without source_file.
    """
    suffix = path.rpartition(".")[2].lower()
    if suffix in EXTRACTORS:
        extract = EXTRACTORS[suffix]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, content in zip(*(c.to_pylist() for c in batch.columns)):
                    rows = [dict(zip(WORDS.names, (name, *row))) for row in extract(content)]
                    yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(WORDS))

        files = spark.read.format("binaryFile").load(path)
        return files.select(F.element_at(F.split("path", "/"), -1), "content").mapInArrow(run, WORDS)
    if suffix == "parquet":
        return spark.read.parquet(path).select(WORDS.names)
    return spark.read.schema(WORDS).option("header", True).csv(path)
