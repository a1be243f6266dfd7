"""Queries of the way from files to the ledger and back: exports, ragged files, sinks, notebooks, rules, texts.

The driver's tables are written as files to the shared folder and read back through the operators.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillweave.config.errors import ExtractionError, InputError
from tillweave.config.profile import parse_profile
from tillweave.config.rules import Rule, chain, valid_rules
from tillweave.functions.columns import flag_text
from tillweave.operators import categorise as K
from tillweave.operators import integrity as I
from tillweave.operators import reports as R
from tillweave.operators.numbering import numbered
from tillweave.plans.ledger_views import led, sql
from tillweave.plans.netting_flows import net_sql, netted
from tillweave.plans.registry import query
from tillweave.plans.rules_integrity import RULES, _FIRST, _LABELLED
from tillweave.render import text as X
from tillweave.session import shared_dir, table
from tillweave.sources import csv_files as V
from tillweave.sources import notebook_rules as N
from tillweave.sources.quoted_scan import scan_records

EXPORT = parse_profile(
    {
        "meta": {"name": "exported", "institution": "Exports", "country": "IE", "source": "csv"},
        "csv": {"column_map": {"Started Date": "date", "Description": "description", "Amount": "amount", "Currency": "currency"}},
        "amounts": {"style": "signed", "thousands": ""},
        "dates": {"format": "%Y-%m-%d %H:%M:%S"},
        "skip_rows": [{"field": "description", "equals": "Britiojol Nursery"}, {"field": "currency", "equals": "GBP"}],
    }
)


def _text_file(lines: DataFrame, order: str, header: str) -> str:
    """Path of one text file with a header and the column `line` of lines, in order."""
    spark = lines.sparkSession
    path = shared_dir(spark, "file")
    head = spark.range(1).select(F.lit(-1).cast("long").alias("_at"), F.lit(header).alias("line"))
    body = lines.select(F.col(order).cast("long").alias("_at"), "line")
    head.unionByName(body).repartition(1).sortWithinPartitions("_at").select("line").write.mode("overwrite").option("lineSep", "\n").text(path)
    return path


def _quoted(c: str) -> F.Column:
    return F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))


def _exports(spark: SparkSession, sf_dir: str) -> list[str]:
    """Two exports that hold the ledger: rows with an even and with an odd ord."""
    day = F.coalesce(F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(" 00:00:00")), F.lit(""))
    cells = [F.lit("CARD"), day, _quoted("description"), F.coalesce(F.col("amount").cast("string"), F.lit("")), F.col("currency")]
    lines = led(spark, sf_dir).select("ord", F.concat_ws(",", *cells).alias("line"))
    return [_text_file(lines.filter(F.col("ord") % 2 == half), "ord", "Type,Started Date,Description,Amount,Currency") for half in (0, 1)]


_EXPORTED = """ex as (select *, row_number() over (partition by ord % 2 order by ord) as n from led)"""


@query("export_rows", sql("""select (ord % 2) * 4294967296 + n as ord, n::int as "row", case when date is null then '' else strftime(date, '%Y-%m-%d') || ' 00:00:00' end as date, description,
  amount::varchar as amount, currency from ex""", _EXPORTED))
def export_rows(spark, sf_dir):
    """Profiled scan of several files, in argument order."""
    frames = [V.read_export(spark, path, EXPORT) for path in _exports(spark, sf_dir)]
    return V.union_in_order(frames).select("ord", "row", "date", "description", "amount", "currency")


@query("export_canonical", sql("""select (ord % 2) * 4294967296 + n as ord, n::int as "row", date, trim(description) as description, amount, nullif(trim(currency), '') as currency, 'exported' as account
  from ex where not (description = 'Britiojol Nursery' or currency = 'GBP')""", _EXPORTED))
def export_canonical(spark, sf_dir):
    """Signed amounts and rows to skip, from text cells."""
    frames = [I.coerce(V.read_export(spark, path, EXPORT), EXPORT) for path in _exports(spark, sf_dir)]
    return V.union_in_order(frames).filter("not _bad").select("ord", "row", "date", "description", "amount", "currency", "account")


_KINDS = """k as (select o_orderkey, o_orderkey % 5 kind, o_custkey::varchar c, o_orderstatus s from orders),
f as (select *, row_number() over (order by o_orderkey) - 1 as n from k where kind <> 3)"""


@query("ragged_rows", f"with {_KINDS} " + """select n as ord, case kind when 2 then c || chr(10) || s else c end as a, case when kind in (0, 2, 4) then s else '' end as b, case kind when 0 then 'x "y"' when 2 then 'z' else '' end as c from f""")
def ragged_rows(spark, sf_dir):
    """Short rows, surplus cells, blank lines and quoted line breaks in one file."""
    kind, c, s = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    line = (
        F.when(kind == 0, F.concat(c, F.lit(","), s, F.lit(',"x ""y"""')))
        .when(kind == 1, c)
        .when(kind == 2, F.concat(F.lit('"'), c, F.lit("\n"), s, F.lit('",'), s, F.lit(",z,surplus,more")))
        .when(kind == 3, F.lit(""))
        .otherwise(F.concat(c, F.lit(","), s, F.lit(",\r")))
    )
    path = _text_file(table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line")), "o_orderkey", "a,b,c")
    return V.read_text_frame(spark, path, ["a", "c"]).select("ord", "a", "b", "c")


@query("scan_records", f"with {_KINDS} " + """select n + 2 as record, case kind when 0 then c || ',"' || s || chr(10) || chr(10) || repeat('"', 2) || 'q' || repeat('"', 3) when 2 then '"' || c || '"' else c || ',mid"' || s end as raw from f""")
def scanned(spark, sf_dir):
    """Records assembled over line breaks, numbered without the blank lines."""
    kind, c, s = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string"), F.col("o_orderstatus")
    line = F.when(kind == 0, F.concat(c, F.lit(',"'), s, F.lit('\n\n""q"""'))).when(kind == 2, F.concat(F.lit('"'), c, F.lit('"'))).when(kind == 3, F.lit("")).otherwise(F.concat(c, F.lit(',mid"'), s))
    path = _text_file(table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line")), "o_orderkey", "h")
    return scan_records(spark, path).filter("record > 1").select("record", "raw")


@query("header_errors", "select * from (values ('required', 'missing column(s): balance, flag'), ('mapped', 'the header lacks Currency, Started Date')) v(\"check\", said)")
def header_errors(spark, sf_dir):
    """What the checks of a file's header say of a file that lacks columns."""
    path = _text_file(table(spark, sf_dir, "region").select("r_regionkey", F.concat_ws(",", "r_name", F.lit("1")).alias("line")), "r_regionkey", "Description,Amount")
    said = []
    for name, check in (("required", lambda: V.read_text_frame(spark, path, ["Amount", "balance", "flag"])), ("mapped", lambda: V.read_export(spark, path, EXPORT))):
        try:
            check()
        except (InputError, ExtractionError) as e:
            said.append((name, str(e)))
    return spark.createDataFrame(said, "check string, said string")


_TEXTS = """select coalesce(strftime(date, '%Y-%m-%d'), '') as date, description, amount::varchar as amount, coalesce(balance::varchar, '') as balance, currency, account, source_file, coalesce(page::varchar, '') as page, "row"::varchar as "row" """


@query("ledger_text", sql(_TEXTS + ", ord from led"))
def ledger_text(spark, sf_dir):
    return V.ledger_text(led(spark, sf_dir))


def _back(spark: SparkSession, df: DataFrame, order: list) -> DataFrame:
    """df through the partitioned sink and back."""
    path = shared_dir(spark, "sink")
    V.write_csv(df, path, order)
    return V.read_text_frame(spark, path).drop("ord")


@query("canonical_csv", sql(_TEXTS + "from led"))
def canonical_csv(spark, sf_dir):
    return _back(spark, V.ledger_text(led(spark, sf_dir)), ["ord"])


@query("typed_ledger", sql("select ord, date, description, amount, balance, account, category, subcategory, is_transfer, currency from led"))
def typed_ledger(spark, sf_dir):
    """A ledger of text cells, as charts read it: columns required, cells typed."""
    rows = led(spark, sf_dir)
    texts = V.ledger_text(rows).join(rows.select("ord", F.col("ord").cast("string").alias("place"), "category", "subcategory", flag_text(F.col("is_transfer")).alias("is_transfer")), "ord")
    path = shared_dir(spark, "sink")
    V.write_csv(texts, path, ["ord"])
    typed = V.typed_ledger(V.read_text_frame(spark, path, V.CHART_COLUMNS))
    return typed.select(F.col("place").cast("long").alias("ord"), "date", "description", "amount", "balance", "account", "category", "subcategory", "is_transfer", "currency")


@query("categorised_csv", sql("select l.ord::varchar as place, l.description, l.amount::varchar as amount, c.category, c.subcategory, case when c.is_transfer then 'True' else 'False' end as is_transfer from c join led l using (ord)", _FIRST, _LABELLED))
def categorised_csv(spark, sf_dir):
    rows = K.categorise(led(spark, sf_dir), RULES)
    shown = rows.select(F.col("ord").cast("string").alias("place"), "description", F.col("amount").cast("string").alias("amount"), "category", "subcategory", flag_text(F.col("is_transfer")).alias("is_transfer"), "ord")
    return _back(spark, shown, ["ord"])


@query("uncategorised_csv", sql("select ord::varchar as place, description, amount::varchar as amount from led where category = ''"))
def uncategorised_csv(spark, sf_dir):
    rows = K.uncategorised(led(spark, sf_dir)).select(F.col("ord").cast("string").alias("place"), "description", F.col("amount").cast("string").alias("amount"), "ord", F.abs("amount").alias("_size"))
    return _back(spark, rows.select("place", "description", "amount", "ord", "_size"), [F.desc("_size"), "ord"]).drop("_size")


@query("unmatched_csv", net_sql("select ord::varchar as place, description, amount::varchar as amount, account from net where is_transfer and pair_id is null"))
def unmatched_csv(spark, sf_dir):
    from tillweave.operators.netting import unmatched

    rows = unmatched(netted(spark, sf_dir))
    return _back(spark, rows.select(F.col("ord").cast("string").alias("place"), "description", F.col("amount").cast("string").alias("amount"), "account", "ord"), ["ord"])


_MONTHS = "m as (select strftime(date, '%Y-%m') as month, case when category = '' then '(uncategorised)' else category end as category, sum(-amount)::decimal(38,2) as amount from led where not is_transfer and amount < 0 and date is not null group by 1, 2)"
_GRID = "g as (select a.month, b.category, coalesce(m.amount, 0)::decimal(38,2) as amount from (select distinct month from m) a cross join (select distinct category from m) b left join m on m.month = a.month and m.category = b.category)"


@query("monthly_delta_csv", sql("select month, category, amount::varchar as amount, coalesce((amount - lag(amount) over (partition by category order by month))::decimal(38,2)::varchar, '') as delta from g", _MONTHS, _GRID))
def monthly_delta_csv(spark, sf_dir):
    return _back(spark, R.month_delta(led(spark, sf_dir)), ["month", "category"])


_PERSONAL = [Rule("prefix", "ATM 1", "Mine/Cash"), Rule("contains", "SALARY", "Mine", "boi_current"), Rule("exact", "NEPOSCHGUSD 12.50", "Mine/Fee", "revolut_current")]


@query("personal_rules_first", """
with o as (select o_orderkey ord, case o_orderkey % 4 when 0 then 'boi_current' else 'revolut_current' end account,
  case o_orderkey % 5 when 0 then 'ATM ' || o_custkey when 1 then 'Transfer to P' || (o_custkey % 50) when 2 then 'ACME SALARY' when 3 then 'NEPOSCHGUSD 12.50' else 'TX' || o_custkey end description from orders),
r as (select *, case when starts_with(description, 'ATM 1') then 1 when account = 'boi_current' and description = 'ACME SALARY' then 2 when account <> 'boi_current' and starts_with(description, 'NEP') then 3
  when account = 'boi_current' and starts_with(description, 'NEP') then 4 when account = 'boi_current' and starts_with(description, 'ATM') then 5 when account = 'boi_current' and starts_with(description, 'TX') then 6
  when account <> 'boi_current' and starts_with(description, 'Transfer') then 7 else 0 end k from o)
select ord, case k when 1 then 'Mine' when 2 then 'Mine' when 3 then 'Mine' when 4 then 'Fees' when 5 then 'Cash' when 6 then 'Card Payment' when 7 then 'Transfer' else '' end as category,
  case k when 1 then 'Cash' when 3 then 'Fee' when 4 then 'Card FX/USD' when 5 then 'ATM' when 7 then substr(description, 13) else '' end as subcategory, k = 7 as is_transfer from r""")
def personal_rules_first(spark, sf_dir):
    key, cust = F.col("o_orderkey") % 5, F.col("o_custkey")
    description = F.when(key == 0, F.concat(F.lit("ATM "), cust)).when(key == 1, F.concat(F.lit("Transfer to P"), cust % 50)).when(key == 2, "ACME SALARY").when(key == 3, "NEPOSCHGUSD 12.50").otherwise(F.concat(F.lit("TX"), cust))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 4 == 0, "boi_current").otherwise("revolut_current").alias("account"), description.alias("description"))
    return K.categorise(rows, chain(_PERSONAL)).select("ord", "category", "subcategory", "is_transfer")


@query("rule_validation", r"""select rule_id, coalesce(match in ('exact', 'contains', 'prefix', 'regex') and pattern <> '' and category is not null and not regexp_matches(category, '(^|/)[\s\x{a0}]*(/|$)')
  and account <> '' and (nullif(extract, '') is null or match = 'regex'), false) as valid from rules""")
def rule_validation(spark, sf_dir):
    return valid_rules(table(spark, sf_dir, "rules")).select("rule_id", "valid")


_BOOK = """b as (select n_name, case n_nationkey % 3 when 0 then 'Savings (' || r_name || ')' when 1 then r_name || ' (' || n_name || ')' else ' ' || r_name end v, n_nationkey % 2 odd, r_name, n_nationkey % 3 kind from nation join region on r_regionkey = n_regionkey),
nr as (select n_name as pattern, case kind when 0 then 'Savings/' || r_name when 1 then r_name || '/' || n_name else r_name end as category, case odd when 0 then 'boi_current' else 'revolut_current' end as account, kind = 0 as transfer from b)"""


def _notebook_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a notebook written from nations and regions: an old dictionary first, then the ones that count."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    kind = F.col("n_nationkey") % 3
    value = F.when(kind == 0, F.concat(F.lit("Savings ("), "r_name", F.lit(")"))).when(kind == 1, F.concat("r_name", F.lit(" ("), "n_name", F.lit(")"))).otherwise(F.concat(F.lit(" "), "r_name"))
    name = F.when(F.col("n_nationkey") % 2 == 0, "details_category_map").otherwise("rev_details_category_map")
    maps = rows.groupBy(name.alias("name")).agg(F.map_from_entries(F.collect_list(F.struct("n_name", value))).alias("m"))
    sources = maps.select(F.array(F.concat("name", F.lit(" = {'Old': 'Gone'}\n"), F.lit("x = 1")), F.concat("name", F.lit(": dict = "), F.to_json("m"))).alias("s"))
    cells = sources.select(F.explode("s").alias("source")).agg(F.array_sort(F.collect_list("source"), lambda a, b: F.instr(b, "Old") - F.instr(a, "Old")).alias("s"))
    # One text for a source, lines for the others; an output that must not be read.
    book = cells.select(F.to_json(F.struct(F.transform("s", lambda s, i: F.struct(F.lit("code").alias("cell_type"), s.alias("source"), F.array(F.struct(F.lit("details_category_map = {}").alias("text"))).alias("outputs"))).alias("cells"))).alias("value"))
    path = shared_dir(spark, "notebook")
    book = book.select(F.regexp_replace("value", r'"source":("(?:[^"\\]|\\.)*Old(?:[^"\\]|\\.)*")', '"source":[$1]').alias("value"))
    book.coalesce(1).write.mode("overwrite").text(path)
    return N.rules_of(N.read_code_cells(spark, path))


@query("notebook_rules", "with " + _BOOK + " select 'exact' as match, pattern, category, account, transfer from nr")
def notebook_rules(spark, sf_dir):
    return _notebook_rules(spark, sf_dir).select("match", "pattern", "category", "account", "transfer")


@query("migration_counts", "with " + _BOOK + " select account, transfer, count(*) as rules from nr group by 1, 2")
def migration_counts(spark, sf_dir):
    return _notebook_rules(spark, sf_dir).groupBy("account", "transfer").agg(F.count("*").alias("rules"))


_BY = "d as (select description, sum(amount)::decimal(38,2) amount, max(abs(amount)) largest, arg_min(ord, (-abs(amount) * 100)::hugeint * 10000000000 + ord) first_place, min(ord) first_ord, count(*) \"rows\" from led where category = '' group by description)"


@query("by_description_order", sql('select description, amount, "rows", row_number() over (order by abs(amount) desc, largest desc, first_place) as place from d', _BY))
def by_description_order(spark, sf_dir):
    rows = led(spark, sf_dir)
    largest = K.uncategorised(rows).groupBy("description").agg(F.max(F.abs("amount")).alias("_largest"))
    ranked = numbered(R.by_description(rows).join(largest, "description"), [F.desc(F.abs("amount")), F.desc("_largest"), "first_ord"], "place", 1)
    return ranked.select("description", "amount", "rows", "place")


@query("triage_order", sql('select description, amount, "rows", row_number() over (order by abs(amount) desc, first_ord) as place from d', _BY))
def triage_order(spark, sf_dir):
    return numbered(R.triage_groups(led(spark, sf_dir)), [F.desc(F.abs("amount")), "first_ord"], "place", 1).select("description", "amount", "rows", "place")


@query("report_texts", sql("""select description, replace(replace(replace(replace(replace(description, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as escaped,
  case when s < 0 then '-' else '' end || 'EUR&nbsp;' || format('{:,.2f}', abs(s)::double) as money,
  '€' || case when abs(s) >= 1000000 then format('{:.1f}M', abs(s)::double / 1000000.0) when abs(s) >= 1000 then format('{:.1f}k', abs(s)::double / 1000.0) when abs(s) >= 10 then format('{:.0f}', abs(s)::double) else format('{:.2f}', abs(s)::double) end as compact,
  case when g = 0 then '—' else format('{:.1f}%', 100 * (s::double / g::double)) end as share, case when d is null then '—' else strftime(d, '%Y-%m-%d') end as day
  from (select description, sum(amount) s, sum(abs(amount)) g, max(date) d from led group by description)"""))
def report_texts(spark, sf_dir):
    """Numbers and texts as the reports show them. They are written in Python, as the reports are, over Arrow batches."""
    sums = led(spark, sf_dir).groupBy("description").agg(F.sum("amount").alias("s"), F.sum(F.abs("amount")).alias("g"), F.max("date").alias("d"))

    def shown(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(
                {
                    "description": b["description"],
                    "escaped": [X.escape(t) for t in b["description"]],
                    "money": [X.money(s, "EUR") for s in b["s"]],
                    "compact": [X.compact(float(s), "EUR") for s in b["s"]],
                    "share": [X.percent(float(s) / float(g) if g else None) for s, g in zip(b["s"], b["g"])],
                    "day": [X.day(d if isinstance(d, dt.date) and not pd.isna(d) else None) for d in b["d"]],
                }
            )

    return sums.mapInPandas(shown, "description string, escaped string, money string, compact string, share string, day string")


@query("colour_texts", "select * from (values ('#000000', '#808080', 'rgba(0,0,0,0.4)'), ('#204060', '#90a0b0', 'rgba(32,64,96,0.4)'), ('#ffffff', '#ffffff', 'rgba(255,255,255,0.4)')) v(colour, tint, rgba)")
def colour_texts(spark, sf_dir):
    return spark.createDataFrame([(c, X.tint(c, 0.5), X.rgba(c, 0.4)) for c in ("#000000", "#204060", "#ffffff")], "colour string, tint string, rgba string")
