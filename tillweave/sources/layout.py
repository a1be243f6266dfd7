"""Rows of a table printed on pages, from the page's words and their boxes.

Input is a word table: source_file, page, page_width, page_height, flow_idx (order of the text flow), text,
x0, x1, top. The words of a page are gathered once, a page being bounded by its paper, and everything about it
(header, columns, end of table, lines, rows) follows from them in one pass over Arrow batches. Documents spread over
the cluster page by page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillweave.config.errors import ExtractionError
from tillweave.config.profile import Profile
from tillweave.config.strategies import ALIGNS, MULTILINES, PAGE_DETECTS, TABLE_ENDS
from tillweave.sources.page_table import PageRules, PrintedPage, Word

PAGE = ("source_file", "page")


def page_rules(profile: Profile) -> PageRules:
    return PageRules(
        tuple((c.header, c.field, c.align) for c in profile.columns), profile.line_tolerance, profile.footer,
        {a: ALIGNS[a] for a in {c.align for c in profile.columns}}, PAGE_DETECTS[profile.page_detect], TABLE_ENDS[profile.table_end], MULTILINES[profile.multiline],
    )


def _by_page(words: DataFrame, profile: Profile, told: Callable[[PrintedPage], list[dict] | None], element: str) -> DataFrame:
    """(source_file, page, told): what told says of each page, as an array of structs; pages of which it is None have no row."""
    rules = page_rules(profile)
    boxes = F.array_sort(F.collect_list(F.struct("flow_idx", "text", "x0", "x1", "top")))
    pages = words.groupBy(*PAGE).agg(F.max("page_width").cast("double").alias("width"), F.max("page_height").cast("double").alias("height"), boxes.alias("words"))
    schema = ", ".join(f"{n} {dict(words.dtypes)[n]}" for n in PAGE) + f", told array<struct<{element}>>"
    types = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    told_type = pa.list_(pa.struct([(f.split(":")[0], types[f.split(":")[1]]) for f in element.split(",")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, heights = (batch.column(c).to_pylist() for c in ("width", "height"))
            lists = batch.column("words")
            ends = lists.offsets.to_pylist()
            flat = lists.flatten()
            start = ends[0]
            fields = [flat.field(i).to_pylist() for i in range(5)]
            kept, out = [], []
            for i, (width, height) in enumerate(zip(widths, heights)):
                own = slice(ends[i] - start, ends[i + 1] - start)
                page = PrintedPage([Word(*w) for w in zip(*(f[own] for f in fields))], width, height, rules)
                found = told(page)
                if found is not None:
                    kept.append(i)
                    out.append(found)
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(pa.array(kept, pa.int64())) for n in PAGE), pa.array(out, told_type)], names=[*PAGE, "told"])

    return pages.mapInArrow(run, schema)


_BOX = "x0:double,field:string,align:string,x1:double,top:double"


def header_blocks(words: DataFrame, profile: Profile) -> DataFrame:
    """blocks: the boxes of the headers from left to right, nulls where one can't be placed on the header line."""

    def told(page: PrintedPage) -> list[dict] | None:
        if page.boxes is None:
            return None
        return sorted((vars(b) for b in page.boxes), key=lambda b: (b["x0"] is not None, b["x0"] or 0, b["field"]))

    return _by_page(words, profile, told, _BOX).withColumnRenamed("told", "blocks")


def column_bounds(words: DataFrame, profile: Profile) -> DataFrame:
    """bounds: half-open intervals of the columns; a boundary is set as its right column's align says."""

    def told(page: PrintedPage) -> list[dict] | None:
        return [dict(zip(("field", "x0", "x1"), b)) for b in page.bounds] if page.placed else None

    return _by_page(words, profile, told, "field:string,x0:double,x1:double").withColumnRenamed("told", "bounds")


def table_lines(words: DataFrame, profile: Profile) -> DataFrame:
    """One row per printed line with the text of each field; lines without any are gone."""
    fields = sorted(profile.fields)
    found = _by_page(words, profile, lambda page: page.table_lines if page.placed else None, ",".join(f"{f}:string" for f in fields))
    return found.select(*PAGE, F.posexplode("told").alias("line_no", "_l")).select(*PAGE, "line_no", *(F.col("_l")[f].alias(f) for f in fields))


def raw_rows(words: DataFrame, profile: Profile) -> DataFrame:
    """Raw text rows of all pages: wrapped descriptions joined, rows without one gone, numbered by file.

    Numbers go on from page to page: a window over the pages of a file adds up how many rows each has.
    """
    fields = sorted(profile.fields)
    found = _by_page(words, profile, lambda page: page.rows if page.placed else None, ",".join(f"{f}:string" for f in fields))
    before = Window.partitionBy("source_file").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    numbered = found.withColumn("_before", F.coalesce(F.sum(F.size("told")).over(before), F.lit(0)))
    rows = numbered.select(*PAGE, "_before", F.posexplode("told").alias("_at", "_r"))
    return rows.select(*PAGE, (F.col("_before") + F.col("_at") + 1).cast("int").alias("row"), *(F.col("_r")[f].alias(f) for f in fields))


def check_layout(words: DataFrame, profile: Profile) -> None:
    """ExtractionError if a file has no page with the header, or a header can't be placed on its line."""
    blocks = header_blocks(words, profile)
    lost = blocks.filter(F.exists("blocks", lambda b: b.x0.isNull())).count()
    if lost:
        raise ExtractionError(f"{lost} page(s) have a header that can't be placed")
    if files := words.select("source_file").distinct().join(blocks.select("source_file").distinct(), "source_file", "left_anti").count():
        raise ExtractionError(f"{files} file(s) have no page with the header line")


def debug_layout(words: DataFrame, profile: Profile, page: int | None = None, rows: int = 5) -> dict[str, DataFrame]:
    """What the layout makes of the pages: header blocks, column bounds and the first rows."""
    some = words if page is None else words.filter(F.col("page") == page)
    return {
        "blocks": header_blocks(some, profile).select(*PAGE, F.inline("blocks")),
        "bounds": column_bounds(some, profile).select(*PAGE, F.inline("bounds")),
        "rows": raw_rows(some, profile).orderBy(*PAGE, "row").limit(rows),
    }


def term_counts(pages: DataFrame, terms: list[str], text_col: str = "text", regex: bool = False, ignore_case: bool = False) -> DataFrame:
    """(term, hits, texts) of search terms over texts; terms that occur nowhere have 0.

    One pass: every text is tried against all terms, and what is shuffled is one partial count per term and task.
    """
    from tillweave.config.rules import java_pattern

    def pattern(term: str) -> str:
        body = java_pattern(term) if regex else "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        return ("(?iu)" if ignore_case else "") + body

    counts = F.array(*(F.struct(F.lit(t).alias("term"), F.coalesce(F.regexp_count(text_col, F.lit(pattern(t))), F.lit(0)).alias("n")) for t in terms))
    hits = pages.select(F.inline(counts))
    return hits.groupBy("term").agg(F.sum("n").cast("long").alias("hits"), F.count_if(F.col("n") > 0).alias("texts"))


def read_terms(arguments: list[str], lines_: list[str]) -> list[str]:
    """Terms of the command line and of a file, blanks and # comments left out, each once in order."""
    clean = (t.strip() for t in lines_)
    return list(dict.fromkeys([*arguments, *(t for t in clean if t and not t.startswith("#"))]))
