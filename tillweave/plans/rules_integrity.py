"""Queries of categorisation, coercion and integrity checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillweave.config.profile import parse_profile
from tillweave.config.rules import Rule, chain
from tillweave.functions import columns as C
from tillweave.operators import categorise as K
from tillweave.operators import integrity as I
from tillweave.plans.ledger_views import led, sql
from tillweave.plans.registry import query
from tillweave.session import table

RULES = [
    Rule("exact", "Britiojol Nursery", "Household/Garden"),
    Rule("prefix", "DD ", "Dwelling/Direct debit"),
    Rule("prefix", "Transfer ", "Transfer", transfer=True),
    Rule("regex", r"^STO (?P<name>[A-Z]+) REF \d+$", "Transfer/Standing order", transfer=True, extract="name"),
    Rule("contains", "ROASTERY", "Eating/Coffee"),
    Rule("contains", "Pharmacy", "Health", account="kestrel_pool_main"),
    Rule("regex", r"(?i)\bcinema\b", "Leisure/Cinema"),
]
_FIRST = """m as (select ord, description, account, case when description = 'Britiojol Nursery' then 0 when starts_with(description, 'DD ') then 1 when starts_with(description, 'Transfer ') then 2
  when regexp_matches(description, '^STO [A-Z]+ REF \\d+$') then 3 when contains(description, 'ROASTERY') then 4 when account = 'kestrel_pool_main' and contains(description, 'Pharmacy') then 5
  when regexp_matches(description, '(?i)\\bcinema\\b') then 6 else -1 end r from led)"""
_LABELLED = """c as (select ord, case r when 0 then 'Household' when 1 then 'Dwelling' when 2 then 'Transfer' when 3 then 'Transfer' when 4 then 'Eating' when 5 then 'Health' when 6 then 'Leisure' else '' end category,
  case r when 0 then 'Garden' when 1 then 'Direct debit' when 3 then 'Standing order/' || regexp_extract(description, '^STO ([A-Z]+) REF', 1) when 4 then 'Coffee' when 6 then 'Cinema' else '' end subcategory, r in (2, 3) is_transfer from m)"""


@query("categorise_chain", sql("select ord, category, subcategory, is_transfer from c", _FIRST, _LABELLED))
def categorise_chain(spark, sf_dir):
    return K.categorise(led(spark, sf_dir), RULES).select("ord", "category", "subcategory", "is_transfer")


@query("rule_hits", sql("select r as rule, count(*) as \"rows\" from m group by r", _FIRST))
def rule_hits(spark, sf_dir):
    return led(spark, sf_dir).groupBy(K.first_match(RULES).alias("rule")).agg(F.count("*").alias("rows"))


@query("categorise_builtin", """
with o as (select o_orderkey ord, case o_orderkey % 4 when 0 then 'boi_current' else 'revolut_current' end account,
  case o_orderkey % 7 when 0 then 'ATM ' || o_custkey when 1 then 'GOVT DUTY ATM ' || o_custkey when 2 then 'TX' || o_custkey when 3 then 'Transfer to P' || (o_custkey % 50) when 4 then 'ACME SALARY' when 5 then 'NEPOSCHGUSD 12.50' else 'SHOP ' || (1000 + o_custkey % 9000) || 'IE' end description from orders)
select ord, case when account = 'boi_current' then case when description like 'NEPOSCHG%' then 'Fees' when starts_with(description, 'GOVT DUTY ATM') then 'Fees' when starts_with(description, 'ATM') then 'Cash' when starts_with(description, 'TX') then 'Card Payment' when regexp_matches(description, '\\d{4}[A-Z]{2}') then 'Card Payment' when contains(description, 'SALARY') then 'Income' else '' end when starts_with(description, 'Transfer to ') then 'Transfer' else '' end as category,
  case when account = 'boi_current' then case when description like 'NEPOSCHG%' then 'Card FX/USD' when starts_with(description, 'GOVT DUTY ATM') then 'ATM Tax' when starts_with(description, 'ATM') then 'ATM' when starts_with(description, 'TX') then '' when regexp_matches(description, '\\d{4}[A-Z]{2}') then 'IE' when contains(description, 'SALARY') then 'Salary' else '' end when starts_with(description, 'Transfer to ') then substr(description, 13) else '' end as subcategory,
  account = 'revolut_current' and starts_with(description, 'Transfer to ') as is_transfer from o""")
def categorise_builtin(spark, sf_dir):
    key = F.col("o_orderkey") % 7
    cust = F.col("o_custkey")
    description = (
        F.when(key == 0, F.concat(F.lit("ATM "), cust))
        .when(key == 1, F.concat(F.lit("GOVT DUTY ATM "), cust))
        .when(key == 2, F.concat(F.lit("TX"), cust))
        .when(key == 3, F.concat(F.lit("Transfer to P"), cust % 50))
        .when(key == 4, "ACME SALARY")
        .when(key == 5, "NEPOSCHGUSD 12.50")
        .otherwise(F.concat(F.lit("SHOP "), 1000 + cust % 9000, F.lit("IE")))
    )
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 4 == 0, "boi_current").otherwise("revolut_current").alias("account"), description.alias("description"))
    return K.categorise(rows, chain([])).select("ord", "category", "subcategory", "is_transfer")


@query("categorise_by_table", sql("""select l.ord, arg_min(r.rule_id, r.idx * 10000000000 + r.rule_id) as rule_id from led l join rules r on (r.account = 'any' or r.account = l.account) and r.pattern <> ''
  and ((r.match = 'exact' and r.pattern = l.description) or (r.match = 'contains' and contains(l.description, r.pattern)) or (r.match = 'prefix' and starts_with(l.description, r.pattern)) or (r.match = 'regex' and regexp_matches(l.description, r.pattern))) group by l.ord"""))
def categorise_by_table(spark, sf_dir):
    return K.categorise_by_table(led(spark, sf_dir), table(spark, sf_dir, "rules"))


@query("paren_to_path", """select rule_id, case when regexp_matches(trim(category), '^(.*?)\\s*\\((.+)\\)\\s*$') then trim(regexp_extract(trim(category), '^(.*?)\\s*\\((.+)\\)\\s*$', 1)) || '/' || trim(regexp_extract(trim(category), '^(.*?)\\s*\\((.+)\\)\\s*$', 2)) else trim(category) end as path from rules""")
def paren_to_path(spark, sf_dir):
    return table(spark, sf_dir, "rules").select("rule_id", C.bracket_to_path(F.col("category")).alias("path"))


@query("path_split", """select rule_id, split_part(category, '/', 1) as head, case when contains(category, '/') then substr(category, position('/' in category) + 1) else '' end as tail from rules where category is not null""")
def path_split(spark, sf_dir):
    return table(spark, sf_dir, "rules").filter("category is not null").select("rule_id", C.path_head(F.col("category")).alias("head"), C.path_tail(F.col("category")).alias("tail"))


# Raw text rows of statements: dates printed now and then, amounts in two columns, balances on every other row.
_RAW = """raw as (select 'stmt_' || (o_custkey % 50) source_file, row_number() over (partition by o_custkey % 50 order by o_orderkey) "row", o_orderkey ord, o_totalprice::decimal(18,2) price, o_orderstatus st, cast(o_orderdate as date) d from orders),
txt as (select *, case when "row" % 3 = 0 then '' else strftime(d, '%d/%m/%Y') end date_text, case when st = 'O' then format('{:,.2f}', price::double) else '' end in_text, case when st <> 'O' then '(' || format('{:,.2f}', price::double) || ')' else '' end out_text,
  case when "row" % 2 = 1 then format('{:,.2f}', (sum(case when st = 'O' then price else price end) over (partition by source_file order by "row"))::double) else '' end balance_text from raw)"""


def raw_text(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("source_file").orderBy("ord")
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("stmt_"), F.col("o_custkey") % 50).alias("source_file"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.col("o_orderstatus").alias("st"), F.col("o_orderdate").cast("date").alias("d")
    )
    rows = rows.withColumn("row", F.row_number().over(w).cast("int"))
    shown = F.format_number("price", 2)
    return rows.select(
        "source_file",
        F.lit(None).cast("int").alias("page"),
        "row",
        "ord",
        F.when(F.col("row") % 3 == 0, "").otherwise(F.date_format("d", "dd/MM/yyyy")).alias("date"),
        F.concat(F.lit(" ORDER "), "ord", F.lit(" ")).alias("description"),
        F.when(F.col("st") == "O", shown).otherwise("").alias("in"),
        F.when(F.col("st") != "O", F.concat(F.lit("("), shown, F.lit(")"))).otherwise("").alias("out"),
        F.when(F.col("row") % 2 == 1, F.format_number(F.sum("price").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2)).otherwise("").alias("balance"),
    )


PROFILE = parse_profile(
    {
        "meta": {"name": "orders_current", "institution": "Orders", "country": "IE", "source": "csv"},
        "csv": {"column_map": {"Date": "date", "Details": "description", "In": "in", "Out": "out", "Balance": "balance"}},
        "amounts": {"style": "in_out"},
        "dates": {"format": "%d/%m/%Y", "fill": "forward"},
        "balance": {"present": True, "validate": "continuity"},
        "skip_rows": [{"field": "description", "equals": "BALANCE FORWARD"}],
    }
)


@query("parse_money_text", sql("select ord, price as value_in, -price as value_out from txt", _RAW))
def parse_money_text(spark, sf_dir):
    raw = raw_text(spark, sf_dir)
    number = lambda c: C.parse_money(F.col(c))
    return raw.select("ord", F.coalesce(number("in"), -number("out")).alias("value_in"), F.coalesce(number("out"), -number("in")).alias("value_out"))


@query("date_fill_forward", sql("select ord, last_value(case when date_text = '' then null else d end ignore nulls) over (partition by source_file order by \"row\" rows unbounded preceding) as date from txt", _RAW))
def date_fill_forward(spark, sf_dir):
    raw = raw_text(spark, sf_dir)
    return raw.withColumn("date", C.parse_date(F.col("date"), "%d/%m/%Y")).select("ord", I.date_forward("date").alias("date"))


@query("in_out_signed", sql("select source_file, \"row\", price as amount from txt", _RAW))
def in_out_signed(spark, sf_dir):
    return I.coerce(raw_text(spark, sf_dir), PROFILE).select("source_file", "row", "amount")


@query("canonical_rows", sql("""select last_value(case when date_text = '' then null else d end ignore nulls) over (partition by source_file order by "row" rows unbounded preceding) as date,
  'ORDER ' || ord as description, price as amount, (sum(price) over (partition by source_file order by "row"))::decimal(18,2) as balance, source_file, "row", 'orders_current' as account from txt""", _RAW))
def canonical_rows(spark, sf_dir):
    return I.coerce(raw_text(spark, sf_dir), PROFILE).select("date", "description", "amount", "balance", "source_file", "row", "account")


_FILL = """r as (select *, count(balance) over (partition by source_file order by "row" rows unbounded preceding) g from led),
f as (select *, case when g > 0 then (first_value(balance) over (partition by source_file, g order by "row") + coalesce(sum(case when balance is null then amount else 0 end) over (partition by source_file, g order by "row" rows unbounded preceding), 0))::decimal(18,2) end filled from r),
v as (select *, (lag(filled) over (partition by source_file order by "row") + amount)::decimal(18,2) expected from f)"""


@query("balance_fill", sql("select ord, filled as balance from f", _FILL))
def balance_fill(spark, sf_dir):
    return I.balance_forward(led(spark, sf_dir)).select("ord", "balance")


@query("balance_violations", sql("select ord, source_file, \"row\", balance as printed, expected from v where balance is not null and expected is not null and abs(expected - balance) > 0.01", _FILL))
def balance_violations(spark, sf_dir):
    return I.balance_violations(led(spark, sf_dir)).select("ord", "source_file", "row", "printed", "expected")


@query("dedupe_keep_first", sql("select ord, date, description, amount, balance, account from led qualify row_number() over (partition by date, description, amount, balance, account order by ord) = 1"))
def dedupe_keep_first(spark, sf_dir):
    return I.dedupe(led(spark, sf_dir)).select("ord", "date", "description", "amount", "balance", "account")


_SKIPPING = parse_profile(
    {
        "meta": {"name": "skipping", "institution": "Skips", "country": "IE", "source": "csv"},
        "csv": {"column_map": {"Date": "date", "Text": "description", "Amount": "amount", "Currency": "currency"}},
        "amounts": {"thousands": ""},
        "skip_rows": [{"field": "description", "equals": "Britiojol Nursery"}, {"field": "currency", "equals": "GBP"}],
    }
)


@query("skip_rows", sql("select source_file, \"row\", trim(description) as description, date from led where not (description = 'Britiojol Nursery' or currency = 'GBP')"))
def skip_rows(spark, sf_dir):
    text = led(spark, sf_dir).select("source_file", "page", "row", F.coalesce(F.date_format("date", "yyyy-MM-dd"), F.lit("")).alias("date"), "description", F.col("amount").cast("string").alias("amount"), "currency")
    return I.coerce(text, _SKIPPING).select("source_file", "row", "description", "date")


_PER = "p as (select account, source_file, min(date) \"start\", max(date) \"end\", min(ord) first_ord from led where date is not null group by account, source_file)"


@query("source_periods", sql('select account, source_file, "start", "end", first_ord from p', _PER))
def source_periods(spark, sf_dir):
    return I.source_periods(led(spark, sf_dir))


@query("period_warnings", sql("""select * from (select account, source_file, "start", lag("end") over w as previous_end, lag(source_file) over w as previous_file,
  case when "start" > lag("end") over w + 1 then 'gap' when "start" <= lag("end") over w then 'overlap' end as kind from p window w as (partition by account order by "start", first_ord)) where kind is not null""", _PER))
def period_warnings(spark, sf_dir):
    return I.period_warnings(I.source_periods(led(spark, sf_dir)))


@query("bad_cells", sql("select \"row\" % 5 as kind, count(*) as bad from txt where \"row\" % 5 in (1, 2) group by 1", _RAW))
def bad_cells(spark, sf_dir):
    kind = F.col("row") % 5
    raw = raw_text(spark, sf_dir)
    raw = raw.withColumn("in", F.when(kind == 1, "12.345").when(kind == 2, "1e3").otherwise(F.col("in")))
    return raw.filter(C.money_is_bad(F.col("in"))).groupBy(kind.cast("long").alias("kind")).agg(F.count("*").alias("bad"))
