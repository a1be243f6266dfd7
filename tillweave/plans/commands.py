"""Queries that run the command line on files written from the driver's tables, and read back what it wrote."""

from __future__ import annotations

import contextlib
import io
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillweave.config.profile import parse_profile
from tillweave.config.errors import ProfileError
from tillweave.config.rules import to_yaml
from tillweave.functions.columns import flag_text
from tillweave.plans.layout_text import _PRINTED, SPEC, printed_pages
from tillweave.plans.ledger_views import FIRST, LAST, led, sql
from tillweave.plans.netting_flows import _CAND, _WALK
from tillweave.plans.parse_path import _quoted, _text_file
from tillweave.plans.registry import query
from tillweave.plans.rules_integrity import _FIRST, _LABELLED, RULES
from tillweave.session import shared_dir, table
from tillweave.sources import csv_files as V


def _place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that the driver can open too."""
    return f"{shared_dir(spark, 'command').removeprefix('file:').replace('//', '/')}/{name}"


def run(*arguments: str) -> tuple[int, str]:
    """(exit status, what was printed) of a command in this session."""
    from tillweave.cli import main

    said = io.StringIO()
    with contextlib.redirect_stdout(said), contextlib.redirect_stderr(said):
        status = main(list(arguments))
    return status, said.getvalue()


def _done(*arguments: str) -> str:
    status, said = run(*arguments)
    if status:
        raise RuntimeError(f"{arguments[0]} ended with {status}: {said}")
    return said


def _ledger_file(spark: SparkSession, sf_dir: str, columns: Sequence[str] = (*V.CHART_COLUMNS, "currency")) -> str:
    rows = led(spark, sf_dir).withColumn("place", F.col("ord"))
    text = {"date": F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("")), "is_transfer": flag_text(F.col("is_transfer"))}
    path = shared_dir(spark, "ledger")
    V.write_csv(rows.select("ord", "place", *(F.coalesce(text.get(c, F.col(c)).cast("string"), F.lit("")).alias(c) for c in columns)), path, ["ord"])
    return path


_EX = """f as (select ord, date, trim(description) as description, amount, currency, balance, count(balance) over (order by ord rows unbounded preceding) g from led),
b as (select *, case when g > 0 then (first_value(balance) over (partition by g order by ord) + coalesce(sum(case when balance is null then amount else 0 end) over (partition by g order by ord rows unbounded preceding), 0))::decimal(18,2) end filled,
  row_number() over (order by ord) n from f),
k as (select * from b qualify row_number() over (partition by date, description, amount, filled order by ord) = 1)"""


@query("command_parse", sql("""select coalesce(strftime(date, '%Y-%m-%d'), '') as date, description, amount::varchar as amount, coalesce(filled::varchar, '') as balance, currency, 'revolut_current' as account, '' as page, n::varchar as "row" from k""", _EX))
def command_parse(spark, sf_dir):
    """parse: an export of delimited text to canonical rows, repeated rows left out."""
    day = F.coalesce(F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(" 08:00:00")), F.lit(""))
    cells = ["CARD", "Current", day, "", _quoted("description"), F.col("amount").cast("string"), "0", F.col("currency"), "DONE", F.coalesce(F.col("balance").cast("string"), F.lit(""))]
    line = F.concat_ws(",", *(F.lit(c) if isinstance(c, str) else c for c in cells))
    export = _text_file(led(spark, sf_dir).select("ord", line.alias("line")), "ord", "Type,Product,Started Date,Completed Date,Description,Amount,Fee,Currency,State,Balance")
    out = _place(spark, "rows.csv")
    _done("parse", export, "--profile", "revolut_current", "--output", out)
    return V.read_text_frame(spark, out).drop("ord", "source_file")


@query("command_categorise", sql("select l.ord::varchar as place, l.description, l.amount::varchar as amount, c.category, c.subcategory, case when c.is_transfer then 'True' else 'False' end as is_transfer from c join led l using (ord)", _FIRST, _LABELLED))
def command_categorise(spark, sf_dir):
    """categorise: rules from a file; the built-in ones behind them are for other accounts."""
    rules, out = _place(spark, "rules.yaml"), _place(spark, "labelled.csv")
    with open(rules, "w", encoding="utf-8") as file:
        file.write(to_yaml(RULES))
    _done("categorise", "--rules", rules, "--in", _ledger_file(spark, sf_dir), "--out", out, "--tolerance", "99999999999")
    return V.read_text_frame(spark, out).select("place", "description", "amount", "category", "subcategory", "is_transfer")


@query("command_report", sql("select ord::varchar as place, description, amount::varchar as amount from led where category = ''"))
def command_report(spark, sf_dir):
    """report: the uncategorised rows."""
    out = _place(spark, "open.csv")
    _done("report", "--in", _ledger_file(spark, sf_dir), "--out", out)
    return V.read_text_frame(spark, out).select("place", "description", "amount")


def _within(text: str) -> str:
    return text.replace("from led where is_transfer", "from rng where is_transfer")


@query("command_chart", sql("select l.ord::varchar as place, l.description, l.amount::varchar as amount from rng l where l.is_transfer and l.ord not in (select i from pairs union all select j from pairs)", _within(_CAND), _WALK.replace(",\nends as", "\n--ends as").split("\n--ends")[0]).replace("with led", "with recursive led", 1))
def command_chart(spark, sf_dir):
    """chart: the transfers of a date range that have no partner in it."""
    out = _place(spark, "figures")
    _done("chart", "monthly", "--in", _ledger_file(spark, sf_dir), "--from", FIRST, "--to", LAST, "--out", out)
    return V.read_text_frame(spark, f"{out}/unmatched_transfers.csv").select("place", "description", "amount")


@query("command_counts", sql("""select * from (select 'categorise' as command, 'categorised ' || count(*) filter (category <> '') || ' of ' || count(*) || ' row(s); ' || count(*) filter (category = '') || ' uncategorised' as said from c
  union all select 'report', 'wrote ' || count(*) || ' uncategorised row(s)' from led where category = '') t""", _FIRST, _LABELLED))
def command_counts(spark, sf_dir):
    """What commands say: counts, and no cell."""
    rules, ledger = _place(spark, "rules.yaml"), _ledger_file(spark, sf_dir)
    with open(rules, "w", encoding="utf-8") as file:
        file.write(to_yaml(RULES))
    categorised = _done("categorise", "--rules", rules, "--in", ledger, "--out", _place(spark, "c.csv"), "--tolerance", "99999999999").partition("; wrote")[0]
    reported = _done("report", "--in", ledger, "--out", _place(spark, "r.csv")).partition(" to ")[0]
    return spark.createDataFrame([("categorise", categorised), ("report", reported)], "command string, said string")


@query("command_debug_layout", sql("select count(*) as said from (select distinct source_file, page from pr where page = 1) cross join range(2 * 4)", _PRINTED))
def command_debug_layout(spark, sf_dir):
    """debug-layout: the boxes and the columns of every first page, four of each."""
    import yaml

    words, profile = _place(spark, "words.parquet"), _place(spark, "pages.yaml")
    printed_pages(spark, sf_dir).write.mode("overwrite").parquet(words)
    with open(profile, "w", encoding="utf-8") as file:
        yaml.safe_dump(SPEC, file)
    said = _done("debug-layout", words, "--profile", profile, "--page", "1", "--max-rows", "0")
    return spark.createDataFrame([(sum(line.startswith("   {") for line in said.splitlines()),)], "said long")


@query("command_migrate", "select 'exact' as match, n_name as pattern, r_name as category, case n_nationkey % 2 when 0 then 'boi_current' else 'revolut_current' end as account from nation join region on r_regionkey = n_regionkey")
def command_migrate(spark, sf_dir):
    """migrate-rules: a notebook to a file of rules."""
    import json

    from tillweave.config.rules import read_rules

    # 25 nations.
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "n_name", "r_name").collect()
    maps = {name: {r.n_name: r.r_name for r in rows if r.n_nationkey % 2 == odd} for odd, name in enumerate(("details_category_map", "rev_details_category_map"))}
    book, out = _place(spark, "book.ipynb"), _place(spark, "migrated.yaml")
    with open(book, "w", encoding="utf-8") as file:
        json.dump({"cells": [{"cell_type": "code", "source": [f"{name} = {entries!r}\n"]} for name, entries in maps.items()]}, file)
    _done("migrate-rules", book, "--out", out)
    return spark.createDataFrame([(r.match, r.pattern, r.category, r.account) for r in read_rules(out)], "match string, pattern string, category string, account string")


_BROKEN = (
    ("section", lambda s: s | {"extra": {}}),
    ("key", lambda s: s | {"rows": {"tolerance": 3}}),
    ("strategy", lambda s: s | {"table_end": {"strategy": "somewhere"}}),
    ("text", lambda s: s | {"table_end": {"strategy": "footer_text"}}),
    ("reserved", lambda s: s | {"dates": {"year_policy": "last"}}),
    ("source", lambda s: s | {"csv": {"column_map": {"a": "date"}}}),
    ("style", lambda s: s | {"amounts": {"style": "in_out"}}),
    ("balance", lambda s: s | {"balance": {"present": False}}),
    ("skip", lambda s: s | {"skip_rows": [{"field": "currency", "equals": "x"}]}),
    ("none", lambda s: s),
)


@query("profile_errors", "select * from (values ('section', true), ('key', true), ('strategy', true), ('text', true), ('reserved', true), ('source', true), ('style', true), ('balance', true), ('skip', true), ('none', false)) v(change, refused)")
def profile_errors(spark, sf_dir):
    """Which changes to a profile its validation refuses."""

    def refused(spec: dict) -> bool:
        try:
            parse_profile(spec)
        except ProfileError:
            return True
        return False

    return spark.createDataFrame([(name, refused(change(dict(SPEC)))) for name, change in _BROKEN], "change string, refused boolean")
