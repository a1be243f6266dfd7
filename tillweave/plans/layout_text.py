"""Queries of the page layout engine and of text search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillweave.config.profile import parse_profile
from tillweave.plans.ledger_views import led, sql
from tillweave.plans.registry import query
from tillweave.session import table
from tillweave.sources import layout as L

SPEC = {
    "meta": {"name": "pages_current", "institution": "Pages", "country": "IE", "source": "pdf"},
    "page_detect": {},
    "columns": [
        {"header": "Date", "field": "date", "align": "left_edge"},
        {"header": "Transaction details", "field": "description", "align": "left_edge"},
        {"header": "Amount", "field": "amount", "align": "left_edge"},
        {"header": "Balance", "field": "balance", "align": "midpoint"},
    ],
    "table_end": {"strategy": "spacing_gap"},
    "rows": {"line_tolerance": 3, "multiline": "merge_into_previous"},
    "balance": {"present": True},
}
PROFILE = parse_profile(SPEC)
#: Where the printer puts the columns.
X = {"date": 40.0, "description": 110.0, "amount": 900.0, "balance": 1000.0}
HEADER = [("Date", 40.0), ("Transaction", 110.0), ("details", 170.0), ("Amount", 900.0), ("Balance", 1000.0)]


def printed_pages(spark, sf_dir):
    """A word table that prints the ledger's pages: one line for each row, a wrapped line for long descriptions."""
    rows = led(spark, sf_dir).filter("page is not null and source_file is not null")
    place = F.row_number().over(Window.partitionBy("source_file", "page").orderBy("row", "ord"))
    rows = rows.withColumn("place", place)
    words = F.filter(F.split("description", r"\s+"), lambda w: w != "")
    cells = F.concat(
        F.when(F.col("date").isNotNull(), F.array(F.struct(F.lit(0).alias("wrap"), F.lit(X["date"]).alias("x0"), F.date_format("date", "yyyy-MM-dd").alias("text")))).otherwise(F.array().cast("array<struct<wrap:int,x0:double,text:string>>")),
        F.transform(words, lambda w, i: F.struct(F.when(i >= 4, 1).otherwise(0).alias("wrap"), (F.lit(X["description"]) + 10 * i).alias("x0"), w.alias("text"))),
        F.array(F.struct(F.lit(0).alias("wrap"), F.lit(X["amount"]).alias("x0"), F.col("amount").cast("string").alias("text"))),
        F.when(F.col("balance").isNotNull(), F.array(F.struct(F.lit(0).alias("wrap"), F.lit(X["balance"]).alias("x0"), F.col("balance").cast("string").alias("text")))).otherwise(F.array().cast("array<struct<wrap:int,x0:double,text:string>>")),
    )
    box = [F.lit(1200.0).alias("page_width"), F.lit(1e6).alias("page_height")]
    body = rows.select("source_file", "page", *box, "place", F.posexplode(cells).alias("n", "_w")).select(
        "source_file", "page", "page_width", "page_height", (F.col("place") * 1000 + F.col("n")).cast("int").alias("flow_idx"), F.col("_w.text").alias("text"), F.col("_w.x0").alias("x0"), (F.col("_w.x0") + 8.0).alias("x1"), (100.0 + F.col("place") * 14 + F.col("_w.wrap") * 7).alias("top")
    )
    heads = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(x).alias("x0")) for t, x in HEADER))
    head = rows.select("source_file", "page").distinct().select("source_file", "page", *box, F.posexplode(heads).alias("flow_idx", "_w")).select(
        "source_file", "page", "page_width", "page_height", "flow_idx", F.col("_w.text").alias("text"), F.col("_w.x0").alias("x0"), (F.col("_w.x0") + 50.0).alias("x1"), F.lit(80.0).alias("top")
    )
    return head.unionByName(body)


_PRINTED = r"""pr as (select *, trim(regexp_replace(description, '\s+', ' ', 'g')) told from led where page is not null and source_file is not null),
rw as (select *, row_number() over (partition by source_file order by page, "row", ord) as "n" from pr where told <> '')"""


@query("layout_rows", sql("""select source_file, page, "n" as "row", coalesce(strftime(date, '%Y-%m-%d'), '') as date, told as description, amount::varchar as amount, coalesce(balance::varchar, '') as balance from rw""", _PRINTED))
def layout_rows(spark, sf_dir):
    return L.raw_rows(printed_pages(spark, sf_dir), PROFILE).select("source_file", "page", F.col("row").cast("long").alias("row"), "date", "description", "amount", "balance")


@query("layout_bounds", sql("""select source_file, page, field, x0::double as x0, x1::double as x1 from (select distinct source_file, page from pr) cross join (values ('date', 0, 110), ('description', 110, 900), ('amount', 900, 975), ('balance', 975, 1200)) v(field, x0, x1)""", _PRINTED))
def layout_bounds(spark, sf_dir):
    return L.column_bounds(printed_pages(spark, sf_dir), PROFILE).select("source_file", "page", F.inline("bounds"))


@query("layout_lines", sql("select source_file, page, count(*) + coalesce(sum(case when len(string_split(told, ' ')) > 4 then 1 end), 0)::bigint as lines from pr group by source_file, page", _PRINTED))
def layout_lines(spark, sf_dir):
    return L.table_lines(printed_pages(spark, sf_dir), PROFILE).groupBy("source_file", "page").agg(F.count("*").alias("lines"))


def _profile(**changes):
    """PROFILE with another end of table, merging of lines or alignment of amounts."""
    spec = {k: dict(v) if isinstance(v, dict) else v for k, v in SPEC.items()}
    spec["table_end"] = {"strategy": changes.get("end", "spacing_gap")} | ({"text": changes["text"]} if "text" in changes else {})
    spec["rows"]["multiline"] = changes.get("multiline", "merge_into_previous")
    spec["columns"] = [c | ({"align": changes["amount"]} if "amount" in changes and c["field"] == "amount" else {}) for c in SPEC["columns"]]
    return parse_profile(spec)


def _with_footer(words, gap: float):
    """words with a footer below each page's last line, and lines under it that look like rows."""
    last = words.groupBy("source_file", "page").agg(F.max("top").alias("t"), F.max("flow_idx").alias("f"))
    printed = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(x).alias("x0"), F.lit(d).alias("down")) for t, x, d in (("Printed", 1100.0, 0.0), ("by", 1120.0, 0.0), ("clerk", 1140.0, 0.0), ("2024-01-01", X["date"], 14.0), ("noise", X["description"], 14.0))))
    foot = last.select("source_file", "page", "t", "f", F.posexplode(printed).alias("n", "w")).select(
        "source_file", "page", F.lit(1200.0).alias("page_width"), F.lit(1e6).alias("page_height"), (F.col("f") + 1 + F.col("n")).cast("int").alias("flow_idx"), F.col("w.text").alias("text"), F.col("w.x0").alias("x0"), (F.col("w.x0") + 8.0).alias("x1"), (F.col("t") + gap + F.col("w.down")).alias("top")
    )
    return words.unionByName(foot)


def _shown(rows):
    return rows.select("source_file", "page", F.col("row").cast("long").alias("row"), "date", "description", "amount", "balance")


_CELLS = "coalesce(strftime(date, '%Y-%m-%d'), '') as date, told as description, amount::varchar as amount, coalesce(balance::varchar, '') as balance"
_PLACED = r"""pl as (select *, row_number() over (partition by source_file, page order by "row", ord) as place, string_split(told, ' ') as ws, count(*) over (partition by source_file, page) as many from pr)"""


@query("layout_footer_rows", sql(f"""select source_file, page, "n" as "row", {_CELLS} from rw""", _PRINTED))
def layout_footer_rows(spark, sf_dir):
    """A table that ends at the line with the footer's text."""
    return _shown(L.raw_rows(_with_footer(printed_pages(spark, sf_dir), 14.0), _profile(end="footer_text", text="Printed by")))


@query("layout_page_bottom_rows", sql(f"""select source_file, page, row_number() over (partition by source_file order by page, place) as "row", {_CELLS} from pl where place <= 4 and told <> ''""", _PRINTED, _PLACED))
def layout_page_bottom_rows(spark, sf_dir):
    """A table that ends a margin above the bottom of the page."""
    return _shown(L.raw_rows(printed_pages(spark, sf_dir).withColumn("page_height", F.lit(180.0)), _profile(end="page_bottom")))


_GAPPED = """ga as (select source_file, page, place, case when place = many and len(ws) > 4 then array_to_string(ws[1:4], ' ') else told end as told, date, amount::varchar as amount, balance::varchar as balance from pl
  where told <> '' and (place < many or len(ws) > 4 or many = 1)
  union all select source_file, page, 2, 'noise', date '2024-01-01', '', '' from pl where many = 1 and len(ws) <= 4)"""


@query("layout_gap_rows", sql(f"""select source_file, page, row_number() over (partition by source_file order by page, place) as "row", {_CELLS} from ga""", _PRINTED, _PLACED, _GAPPED))
def layout_gap_rows(spark, sf_dir):
    """A table that ends at a wide gap: the line before the gap is where it ends, so that line is out.

    On a page of one line no gap is wide against the usual one, so what is printed below the footer is read too.
    """
    pages = _with_footer(printed_pages(spark, sf_dir), 400.0)
    return _shown(L.raw_rows(pages, _profile(end="spacing_gap")))


@query("layout_unmerged_rows", sql("""select source_file, page, row_number() over (partition by source_file order by page, place, wrap) as "row", case wrap when 0 then coalesce(strftime(date, '%Y-%m-%d'), '') else '' end as date,
  case wrap when 0 then array_to_string(ws[1:4], ' ') else array_to_string(ws[5:], ' ') end as description, case wrap when 0 then amount::varchar else '' end as amount, case wrap when 0 then coalesce(balance::varchar, '') else '' end as balance
  from pl cross join (values (0), (1)) v(wrap) where told <> '' and (wrap = 0 or len(ws) > 4)""", _PRINTED, _PLACED))
def layout_unmerged_rows(spark, sf_dir):
    """Every printed line is a row of its own."""
    return _shown(L.raw_rows(printed_pages(spark, sf_dir), _profile(multiline="none")))


@query("layout_right_edge_bounds", sql("""select source_file, page, field, x0::double as x0, x1::double as x1 from (select distinct source_file, page from pr) cross join (values ('date', 0, 110), ('description', 110, 950), ('amount', 950, 975), ('balance', 975, 1200)) v(field, x0, x1)""", _PRINTED))
def layout_right_edge_bounds(spark, sf_dir):
    return L.column_bounds(printed_pages(spark, sf_dir), _profile(amount="right_edge")).select("source_file", "page", F.inline("bounds"))


@query("layout_debug_boxes", sql("""select source_file, page, field, align, x0::double as x0, x1::double as x1, 80::double as top from (select distinct source_file, page from pr) cross join (values ('date', 'left_edge', 40, 90), ('description', 'left_edge', 110, 220), ('amount', 'left_edge', 900, 950), ('balance', 'midpoint', 1000, 1050)) v(field, align, x0, x1)""", _PRINTED))
def layout_debug_boxes(spark, sf_dir):
    return L.debug_layout(printed_pages(spark, sf_dir), PROFILE)["blocks"].select("source_file", "page", "field", "align", "x0", "x1", "top")


TERMS = ["Traceback", "import pandas", "JavaScript", "$\\hat{y}", "zzz-never-there"]
_TERMS_SQL = "terms(term) as (values ('Traceback'), ('import pandas'), ('JavaScript'), ('$\\hat{y}'), ('zzz-never-there'))"
_HITS = f"with {_TERMS_SQL}, h as (select term, case when text is null then 0 else len(string_split(text, term)) - 1 end n from documents cross join terms)"


@query("redaction_term_counts", _HITS + " select term, sum(n)::bigint as hits, count(*) filter (n > 0) as texts from h group by term")
def redaction_term_counts(spark, sf_dir):
    return L.term_counts(table(spark, sf_dir, "documents"), TERMS)


@query("redaction_terms_missing", _HITS + " select term from h group by term having sum(n) = 0")
def redaction_terms_missing(spark, sf_dir):
    return L.term_counts(table(spark, sf_dir, "documents"), TERMS).filter("hits = 0").select("term")
