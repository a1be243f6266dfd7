"""Records of delimited text files of any size: quoted fields may go on over line breaks, and files are split.

Whether a line break ends a record depends on all quotes before it, but for a whole split only on one bit: whether
it begins inside a quoted field. A first pass reads each split for both answers and keeps a row of it: how many
lines and records it has, how it ends, and the pieces of records at its edges. A fold over the splits of each file
(one row for each) then tells which answer holds, where the numbers of records begin, and what the records that
cross a split are. The second pass cuts each split into its whole records. Nothing but those rows is moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillweave.session import written

RECORDS = "source_file string, record long, line long, raw string"


class QuoteScanner:
    """Whether a line, begun inside a quoted field or not, ends inside one. Only a field's first character opens quotes."""

    def __init__(self, delimiter: str = ",", quote: str = '"') -> None:
        self.delimiter, self.quote = delimiter, quote

    def ends_inside(self, line: str, inside: bool) -> bool:
        at, fresh = 0, not inside
        while at < len(line):
            if inside:
                close = line.find(self.quote, at)
                if close < 0:
                    return True
                if line[close + 1 : close + 2] == self.quote:
                    at = close + 2
                    continue
                inside, fresh, at = False, False, close + 1
            elif fresh and line[at] == self.quote:
                inside, at = True, at + 1
            else:
                stop = line.find(self.delimiter, at)
                if stop < 0:
                    return False
                fresh, at = True, stop + 1
        return inside


class SplitReader:
    """Cuts the lines of one split into records, given whether it begins inside a quoted field.

    head: the lines that belong to a record of an earlier split. whole: (record, line, text) of the records that
    begin and end here, counted from 0. tail: the record that goes on behind the split. Empty lines between
    records are none and have no number.
    """

    def __init__(self, scanner: QuoteScanner, inside: bool, keep: bool) -> None:
        self.scanner, self.inside, self.keep = scanner, inside, keep
        self.head: list[str] | None = [] if inside else None
        self.closed = not inside
        self.records = self.lines = 0
        self.held: list[str] = []
        self.held_line = 0
        self.whole: list[tuple[int, int, str]] = []

    def take(self, line: str, quoted: bool) -> None:
        begins = not self.inside
        self.lines += 1
        if begins and line in ("", "\r"):
            return
        if quoted:
            self.inside = self.scanner.ends_inside(line, self.inside)
        if begins:
            self.records += 1
            self.held, self.held_line = [line], self.lines - 1
        elif self.closed:
            self.held.append(line)
        else:
            self.head.append(line)
            self.closed = not self.inside
            return
        if not self.inside:
            if self.keep:
                self.whole.append((self.records - 1, self.held_line, "\n".join(self.held)))
            self.held = []


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").option("encoding", encoding).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value"))


def _splits(batches: Iterator[pa.RecordBatch], quote: str) -> Iterator[tuple[tuple[str, int], pa.RecordBatch, Iterator[tuple[str, bool]]]]:
    """(split, its part of a batch, its lines, each with whether it holds a quote)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        file, split = batch.column(0), batch.column(1)
        if n > 1:
            differs = pc.or_(pc.not_equal(file.slice(1), file.slice(0, n - 1)), pc.not_equal(split.slice(1), split.slice(0, n - 1)))
            cuts = [0, *(i + 1 for i in pc.indices_nonzero(differs).to_pylist()), n]
        else:
            cuts = [0, n]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            values = part.column(2)
            quoted = pc.match_substring(values, quote)
            yield (file[a].as_py(), split[a].as_py()), part, zip(values.to_pylist(), quoted.to_pylist())


_EDGES = "file string, split long, lines long, closed boolean, head string, " + ", ".join(f"records{s} long, open{s} boolean, tail{s} string, tail_line{s} long" for s in (0, 1))


def _edges(lines: DataFrame, scanner: QuoteScanner) -> DataFrame:
    """One row for each split: what it comes to if it begins outside (0) or inside (1) a quoted field."""
    names = [c.strip().split(" ")[0] for c in _EDGES.split(",")]

    def row(key: tuple[str, int], readers: tuple[SplitReader, SplitReader]) -> list:
        out = [*key, readers[0].lines, readers[1].closed, "\n".join(readers[1].head)]
        for r in readers:
            out += [r.records, r.inside and bool(r.held), "\n".join(r.held) if r.inside and r.held else None, r.held_line]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, readers, rows = None, None, []
        for key, _, lines_ in _splits(batches, scanner.quote):
            if key != held:
                if readers:
                    rows.append(row(held, readers))
                held, readers = key, (SplitReader(scanner, False, False), SplitReader(scanner, True, False))
            for line, quoted in lines_:
                for r in readers:
                    r.take(line, quoted)
        if readers:
            rows.append(row(held, readers))
        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(c.strip().split(" ")[0], kinds[c.strip().split(" ")[1]]) for c in _EDGES.split(",")])
    return lines.mapInArrow(run, _EDGES)


_FOLDED = "file string, split long, inside boolean, record long, line long, raw string"


def _fold(edges: pd.DataFrame) -> pd.DataFrame:
    """Splits of one file with how they begin (raw is null), and the records that cross splits."""
    out, inside, record, line = [], False, 0, 0
    crossing: list | None = None  # [record, line, pieces] of the record that is open
    for e in edges.sort_values("split").to_dict("records"):
        s = int(inside)
        out.append((e["file"], e["split"], inside, record, line, None))
        if inside:
            crossing[2].append(e["head"])
            if e["closed"]:
                out.append((e["file"], e["split"], None, crossing[0], crossing[1], "\n".join(crossing[2])))
                crossing = None
        if e[f"open{s}"]:
            crossing = [record + e[f"records{s}"] - 1, line + e[f"tail_line{s}"], [e[f"tail{s}"]]]
        record += e[f"records{s}"]
        line += e["lines"]
        inside = crossing is not None
    if crossing:  # a quoted field that never ends takes the rest of its file
        out.append((edges["file"].iloc[0], -1, None, crossing[0], crossing[1], "\n".join(crossing[2])))
    return pd.DataFrame(out, columns=["file", "split", "inside", "record", "line", "raw"])


def scan_records(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8") -> DataFrame:
    """(source_file, record, line, raw): the records of the text files at path, numbered from 1 within their file.

    line is the number of a record's first line. Empty lines between records are no records. A carriage return
    before a line feed stays part of its line. A quoted field that never ends takes the rest of its file; an
    empty file has no records.
    """
    scanner = QuoteScanner(delimiter)
    lines = _lines(spark, path, encoding)
    folded = written(_edges(lines, scanner).groupBy("file").applyInPandas(_fold, _FOLDED), "splits")
    # One row for each split of a file, so about a millionth of the data.
    begins = F.broadcast(folded.filter("raw is null").select("file", "split", "inside", "record", "line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, reader = None, None
        for key, part, lines_ in _splits(batches, scanner.quote):
            if key != held:
                held, reader = key, SplitReader(scanner, part.column("inside")[0].as_py(), True)
            for line, quoted in lines_:
                reader.take(line, quoted)
            record, at = part.column("record")[0].as_py(), part.column("line")[0].as_py()
            numbers, places, texts = zip(*reader.whole) if reader.whole else ((), (), ())
            reader.whole = []
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(numbers), pa.string()), pa.array([record + n for n in numbers], pa.int64()), pa.array([at + p for p in places], pa.int64()), pa.array(texts, pa.string())],
                names=["source_file", "record", "line", "raw"],
            )

    whole = lines.join(begins, ["file", "split"]).select("file", "split", "value", "inside", "record", "line").mapInArrow(run, RECORDS)
    crossing = folded.filter("raw is not null").select(F.col("file").alias("source_file"), "record", "line", "raw")
    name = F.element_at(F.split("source_file", "/"), -1)
    found = whole.unionByName(crossing)
    return found.select(F.url_decode(name).alias("source_file"), (F.col("record") + 1).alias("record"), (F.col("line") + 1).alias("line"), "raw")


def first_record(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8", lines: int = 1000) -> str | None:
    """The first record of a file, from its first lines."""
    reader = SplitReader(QuoteScanner(delimiter), False, True)
    for row in _lines(spark, path, encoding).filter("split = 0").limit(lines).collect():
        reader.take(row.value, '"' in row.value)
        if reader.whole:
            return reader.whole[0][2]
    return None
