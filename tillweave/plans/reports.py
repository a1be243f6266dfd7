"""Queries of the report layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillweave.functions import columns as C
from tillweave.operators import reports as R
from tillweave.plans.ledger_views import FIRST, LAST, led, sql
from tillweave.plans.registry import query

SPEND, INCOME = "not is_transfer and amount < 0", "not is_transfer and amount > 0"
LABEL = "coalesce(nullif(trim(category), ''), '(uncategorised)')"
SAVING = "saving|pension|fund"
KEPT = "ord, date, description, amount, account, category, subcategory, is_transfer"


def _kept(df):
    return df.select(*KEPT.split(", "))


def inside(spark, sf_dir):
    return led(spark, sf_dir).filter(C.in_range(FIRST, LAST))


@query("ledger_rows", sql(f"select {KEPT}, balance, currency, source_file, page, \"row\" from led"))
def ledger_rows(spark, sf_dir):
    return led(spark, sf_dir)


@query("range_filter", sql(f"select {KEPT} from rng"))
def range_filter(spark, sf_dir):
    return _kept(inside(spark, sf_dir))


@query("spend_rows", sql(f"select {KEPT} from led where {SPEND}"))
def spend_rows(spark, sf_dir):
    return _kept(led(spark, sf_dir).filter(C.is_spend()))


@query("income_rows", sql(f"select {KEPT} from led where {INCOME}"))
def income_rows(spark, sf_dir):
    return _kept(led(spark, sf_dir).filter(C.is_income()))


@query("transfer_rows", sql(f"select {KEPT} from led where is_transfer"))
def transfer_rows(spark, sf_dir):
    return _kept(led(spark, sf_dir).filter("is_transfer"))


@query("uncategorised_rows", sql(f"select {KEPT} from led where category = ''"))
def uncategorised_rows(spark, sf_dir):
    return _kept(led(spark, sf_dir).filter(F.col("category") == ""))


@query("uncategorised_blank_rows", sql(f"select {KEPT} from led where trim(category) = '' and not is_transfer"))
def uncategorised_blank_rows(spark, sf_dir):
    return _kept(led(spark, sf_dir).filter((F.trim("category") == "") & ~F.col("is_transfer")))


@query("month_key", sql("select ord, strftime(date, '%Y-%m') as month from led where date is not null"))
def month_key(spark, sf_dir):
    return led(spark, sf_dir).filter("date is not null").select("ord", C.month_key("date").alias("month"))


@query("month_span", sql("select account, count(distinct strftime(date, '%Y-%m')) as months from rng group by account"))
def month_span(spark, sf_dir):
    return inside(spark, sf_dir).groupBy("account").agg(F.countDistinct(C.month_key("date")).alias("months"))


@query("category_label", sql(f"select ord, {LABEL} as label from led"))
def category_label(spark, sf_dir):
    return led(spark, sf_dir).select("ord", C.category_label(F.col("category")).alias("label"))


@query("income_label", sql(f"select ord, coalesce(nullif(subcategory, ''), nullif(category, ''), '(uncategorised)') as label from led where {INCOME}"))
def income_label(spark, sf_dir):
    return led(spark, sf_dir).filter(C.is_income()).select("ord", C.income_label(F.col("category"), F.col("subcategory")).alias("label"))


@query("stat_tiles", sql("""
select income, spend, (income - spend)::decimal(38,2) as net, case when income <> 0 then round((income - spend)::double / income::double, 6) end as savings_rate, currency from s""", f"""s as (select coalesce(sum(case when {INCOME} then amount end), 0)::decimal(38,2) income, coalesce(sum(case when {SPEND} then -amount end), 0)::decimal(38,2) spend,
  case when count(distinct nullif(trim(currency), '')) = 1 then min(nullif(trim(currency), '')) end currency from rng)"""))
def stat_tiles(spark, sf_dir):
    return R.stat_tiles(inside(spark, sf_dir))


@query("currency_agreement", sql("select case when count(distinct nullif(trim(currency), '')) = 1 then min(nullif(trim(currency), '')) end as currency from led"))
def currency_agreement(spark, sf_dir):
    return R.currency_agreement(led(spark, sf_dir))


@query("spend_by_category", sql(f"select {LABEL} as category, sum(-amount)::decimal(38,2) as amount from rng where {SPEND} group by 1"))
def spend_by_category(spark, sf_dir):
    return R.spend_by(inside(spark, sf_dir), C.category_label(F.col("category")), "category")


@query("top_categories", sql(f"select {LABEL} as category, sum(-amount)::decimal(38,2) as amount from rng where {SPEND} group by 1 order by 2 desc, 1 limit 10"))
def top_categories(spark, sf_dir):
    return R.top_categories(inside(spark, sf_dir))


@query("top_merchants", sql(f"select description as merchant, sum(-amount)::decimal(38,2) as amount from rng where {SPEND} group by 1 order by 2 desc, 1 limit 10"))
def top_merchants(spark, sf_dir):
    return R.top_merchants(inside(spark, sf_dir))


_BEFORE, _UNTIL = R.prior_window(FIRST, LAST)
_MOVERS = f"""c as (select {LABEL} category, coalesce(sum(case when date between date '{FIRST}' and date '{LAST}' then -amount end), 0)::decimal(38,2) "current",
  coalesce(sum(case when date between date '{_BEFORE}' and date '{_UNTIL}' then -amount end), 0)::decimal(38,2) prior from led where {SPEND} and date between date '{_BEFORE}' and date '{LAST}' group by 1),
d as (select *, ("current" - prior)::decimal(38,2) delta from c where "current" <> prior)"""


@query("movers_all", sql('select category, "current", prior, delta from d', _MOVERS))
def movers_all(spark, sf_dir):
    return R.movers(led(spark, sf_dir), FIRST, LAST)


@query("movers_top", sql("""select * from (select category, "current", prior, delta, case when delta > 0 then 'up' else 'down' end as direction,
  row_number() over (partition by delta > 0 order by abs(delta) desc, category) as rank from d) where rank <= 5""", _MOVERS))
def movers_top(spark, sf_dir):
    return R.top_movers(led(spark, sf_dir), FIRST, LAST)


@query("movers_coverage", sql(f"select count(*) filter (date between date '{_BEFORE}' and date '{_UNTIL}') as prior_rows, count(*) filter (date between date '{_BEFORE}' and date '{_UNTIL}') > 0 as covered from led"))
def movers_coverage(spark, sf_dir):
    return R.prior_coverage(led(spark, sf_dir), FIRST, LAST)


@query("notables", sql(f"select {KEPT} from rng where not is_transfer order by abs(amount) desc, ord limit 10"))
def notables(spark, sf_dir):
    return _kept(R.notables(inside(spark, sf_dir)))


@query("health_summary", sql("select count(*) filter (not is_transfer and trim(category) = '') as uncategorised, coalesce(sum(abs(amount)) filter (not is_transfer and trim(category) = ''), 0)::decimal(38,2) as amount from rng"))
def health_summary(spark, sf_dir):
    return R.health(inside(spark, sf_dir))


@query("account_coverage", sql("select account, min(date) as first_date, max(date) as last_date, count(*) as \"rows\" from led group by account"))
def account_coverage(spark, sf_dir):
    return R.account_coverage(led(spark, sf_dir))


@query("run_counts", sql(f"""select count(*) as "read", count(*) filter (date between date '{FIRST}' and date '{LAST}') as in_range,
  count(*) filter (date between date '{FIRST}' and date '{LAST}' and not is_transfer and category = '') as uncategorised from led"""))
def run_counts(spark, sf_dir):
    return R.run_counts(led(spark, sf_dir), F.coalesce(C.in_range(FIRST, LAST), F.lit(False)))


@query("accounts_in_range", sql("select distinct account from rng order by account"))
def accounts_in_range(spark, sf_dir):
    return inside(spark, sf_dir).select("account").distinct().orderBy("account")


_MONTHS = f"m as (select strftime(date, '%Y-%m') as month, case when category = '' then '(uncategorised)' else category end as category, sum(-amount)::decimal(38,2) as amount from led where {SPEND} and date is not null group by 1, 2)"
_GRID = "g as (select a.month, b.category, coalesce(m.amount, 0)::decimal(38,2) as amount from (select distinct month from m) a cross join (select distinct category from m) b left join m on m.month = a.month and m.category = b.category)"


@query("monthly_totals", sql("select month, category, amount from m", _MONTHS))
def monthly_totals(spark, sf_dir):
    return R.month_totals(led(spark, sf_dir))


@query("monthly_grid", sql("select month, category, amount from g", _MONTHS, _GRID))
def monthly_grid(spark, sf_dir):
    return R.month_grid(led(spark, sf_dir))


@query("monthly_delta", sql("select month, category, amount, (amount - lag(amount) over (partition by category order by month))::decimal(38,2) as delta from g", _MONTHS, _GRID))
def monthly_delta(spark, sf_dir):
    return R.month_delta(led(spark, sf_dir))


_SAVED = f"regexp_matches(category, '(?i){SAVING}') or regexp_matches(subcategory, '(?i){SAVING}')"


@query("savings_rows", sql(f"select {KEPT} from led where {_SAVED}"))
def savings_rows(spark, sf_dir):
    return _kept(R.savings_rows(led(spark, sf_dir), SAVING))


@query("savings_by_date", sql(f"select date, sum(amount)::decimal(38,2) as amount from led where ({_SAVED}) and date is not null group by date"))
def savings_by_date(spark, sf_dir):
    return R.savings_by_date(led(spark, sf_dir), SAVING)


@query("savings_cumulative", sql("select date, amount, (sum(amount) over (order by date rows unbounded preceding))::decimal(38,2) as cumulative from v", f"v as (select date, sum(amount)::decimal(38,2) as amount from led where ({_SAVED}) and date is not null group by date)"))
def savings_cumulative(spark, sf_dir):
    return R.savings_cumulative(led(spark, sf_dir), SAVING)


@query("balance_trajectory", sql("select account, date, arg_max(balance, ord) as balance from led where balance is not null and date is not null group by account, date"))
def balance_trajectory(spark, sf_dir):
    return R.balance_trajectory(led(spark, sf_dir))


@query("uncategorised_report", sql(f"select {KEPT}, row_number() over (order by abs(amount) desc, ord) as place from led where category = ''"))
def uncategorised_report(spark, sf_dir):
    from tillweave.operators.numbering import numbered

    return numbered(_kept(led(spark, sf_dir).filter(F.col("category") == "")), [F.desc(F.abs("amount")), "ord"], "place", 1)


@query("uncategorised_by_description", sql("select description, sum(amount)::decimal(38,2) as amount, count(*) as \"rows\", arg_min(ord, (-abs(amount) * 100)::hugeint * 10000000000 + ord) as first_ord from led where category = '' group by description"))
def uncategorised_by_description(spark, sf_dir):
    return R.by_description(led(spark, sf_dir))


@query("triage_groups", sql("select description, count(*) as \"rows\", sum(amount)::decimal(38,2) as amount, min(ord) as first_ord from led where category = '' group by description"))
def triage_groups(spark, sf_dir):
    return R.triage_groups(led(spark, sf_dir))


@query("description_account", sql("select description, case when count(distinct account) = 1 then min(account) else 'any' end as account from led group by description"))
def description_account(spark, sf_dir):
    return R.description_account(led(spark, sf_dir))


@query("category_menu", sql("select distinct case when subcategory = '' then category else category || '/' || subcategory end as path from led where category <> ''"))
def category_menu(spark, sf_dir):
    path = F.when(F.col("subcategory") == "", F.col("category")).otherwise(F.concat_ws("/", "category", "subcategory"))
    return led(spark, sf_dir).filter(F.col("category") != "").select(path.alias("path")).distinct()


@query("tolerance_gate", sql("select count(*) as \"rows\", count(*) filter (category = '') as uncategorised, coalesce(sum(abs(amount)) filter (category = ''), 0)::decimal(38,2) as amount, coalesce(sum(abs(amount)) filter (category = ''), 0) <= 100000 as passes from led"))
def tolerance_gate(spark, sf_dir):
    from tillweave.operators.categorise import gate

    return gate(led(spark, sf_dir), "100000")
