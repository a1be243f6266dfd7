"""The report layer: tiles, rankings, movers, notables, health, months, savings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillweave.functions.columns import TOTAL, category_label, is_income, is_spend, month_key, total
from tillweave.session import broadcast_if_small


def currency_agreement(rows: DataFrame) -> DataFrame:
    """One row: the only currency there is, null where there are several or none."""
    named = F.nullif(F.trim("currency"), F.lit(""))
    return rows.agg(F.when(F.min(named) == F.max(named), F.min(named)).alias("currency"))


def stat_tiles(rows: DataFrame) -> DataFrame:
    """One row: income, spend (positive), net, savings rate (null without income) and currency; one pass."""
    named = F.nullif(F.trim("currency"), F.lit(""))
    sums = rows.agg(
        total(F.when(is_income(), F.col("amount"))).alias("income"),
        total(F.when(is_spend(), -F.col("amount"))).alias("spend"),
        F.when(F.min(named) == F.max(named), F.min(named)).alias("currency"),
    )
    net = (F.col("income") - F.col("spend")).cast(TOTAL)
    rate = F.when(F.col("income") != 0, F.round(net.cast("double") / F.col("income").cast("double"), 6))
    return sums.select("income", "spend", net.alias("net"), rate.alias("savings_rate"), "currency")


def spend_by(rows: DataFrame, key, name: str) -> DataFrame:
    return rows.filter(is_spend()).groupBy(key.alias(name)).agg(total(-F.col("amount")).alias("amount"))


def top_categories(rows: DataFrame, n: int = 10) -> DataFrame:
    return spend_by(rows, category_label(F.col("category")), "category").orderBy(F.desc("amount"), "category").limit(n)


def top_merchants(rows: DataFrame, n: int = 10) -> DataFrame:
    return spend_by(rows, F.col("description"), "merchant").orderBy(F.desc("amount"), "merchant").limit(n)


def prior_window(first: str, last: str) -> tuple[str, str]:
    """The window of as many days that ends the day before first."""
    a, b = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    return str(a - (b - a) - dt.timedelta(1)), str(a - dt.timedelta(1))


def movers(rows: DataFrame, first: str, last: str) -> DataFrame:
    """(category, current, prior, delta) of spend, changes only; both windows from one scan."""
    before, until = prior_window(first, last)
    day = F.col("date")
    now, then = day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), day.between(F.lit(before).cast("date"), F.lit(until).cast("date"))
    sums = (
        rows.filter(is_spend() & day.between(F.lit(before).cast("date"), F.lit(last).cast("date")))
        .groupBy(category_label(F.col("category")).alias("category"))
        .agg(total(F.when(now, -F.col("amount"))).alias("current"), total(F.when(then, -F.col("amount"))).alias("prior"))
    )
    return sums.withColumn("delta", (F.col("current") - F.col("prior")).cast(TOTAL)).filter("delta <> 0")


def top_movers(rows: DataFrame, first: str, last: str, n: int = 5) -> DataFrame:
    """The n largest increases and decreases, ranked in each direction."""
    changed = movers(rows, first, last)
    up = changed.filter("delta > 0").orderBy(F.desc("delta"), "category").limit(n).withColumn("direction", F.lit("up"))
    down = changed.filter("delta < 0").orderBy("delta", "category").limit(n).withColumn("direction", F.lit("down"))
    rank = F.row_number().over(Window.partitionBy("direction").orderBy(F.desc(F.abs("delta")), "category")).cast("long")
    return up.unionByName(down).withColumn("rank", rank)


def prior_coverage(rows: DataFrame, first: str, last: str) -> DataFrame:
    """One row: how many rows of any kind lie in the prior window, and whether there are any."""
    before, until = prior_window(first, last)
    inside = F.col("date").between(F.lit(before).cast("date"), F.lit(until).cast("date"))
    return rows.agg(F.count_if(inside).alias("prior_rows")).withColumn("covered", F.col("prior_rows") > 0)


def notables(rows: DataFrame, n: int = 10) -> DataFrame:
    """The n largest rows that are no transfers, by absolute amount, earlier rows first among equals."""
    return rows.filter(~F.col("is_transfer")).orderBy(F.desc(F.abs("amount")), "ord").limit(n)


def health(rows: DataFrame) -> DataFrame:
    """One row: uncategorised rows (no transfers; blank after trimming) and what they sum to, absolutely."""
    open_ = ~F.col("is_transfer") & (F.trim("category") == "")
    return rows.agg(F.count_if(open_).alias("uncategorised"), total(F.when(open_, F.abs("amount"))).alias("amount"))


def account_coverage(rows: DataFrame) -> DataFrame:
    return rows.groupBy("account").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("rows"))


def month_totals(rows: DataFrame) -> DataFrame:
    """(month, category, amount) of spend, positive."""
    label = F.when(F.col("category") == "", "(uncategorised)").otherwise(F.col("category"))
    return rows.filter(is_spend() & F.col("date").isNotNull()).groupBy(month_key("date").alias("month"), label.alias("category")).agg(total(-F.col("amount")).alias("amount"))


def month_grid(rows: DataFrame) -> DataFrame:
    """Every month with spend by every category with spend, 0 where there was none.

    Months and categories are aggregates of calendar and rule size; their product is the report itself.
    """
    totals = month_totals(rows)
    months, categories = totals.select("month").distinct(), totals.select("category").distinct()
    grid = months.join(broadcast_if_small(categories))
    return grid.join(totals, ["month", "category"], "left").withColumn("amount", F.coalesce("amount", F.lit(0)).cast(TOTAL))


def month_delta(rows: DataFrame) -> DataFrame:
    """The grid with the change against the month before that has spend; null in the first month."""
    by_month = Window.partitionBy("category").orderBy("month")
    return month_grid(rows).withColumn("delta", (F.col("amount") - F.lag("amount").over(by_month)).cast(TOTAL))


def savings_rows(rows: DataFrame, pattern: str) -> DataFrame:
    """Rows whose category or subcategory matches pattern, in any case; transfers among them."""
    return rows.filter(F.col("category").rlike(f"(?i){pattern}") | F.col("subcategory").rlike(f"(?i){pattern}"))


def savings_by_date(rows: DataFrame, pattern: str) -> DataFrame:
    return savings_rows(rows, pattern).filter(F.col("date").isNotNull()).groupBy("date").agg(total("amount").alias("amount"))


def savings_cumulative(rows: DataFrame, pattern: str) -> DataFrame:
    """Running sum over the dates. One task orders one row for each day of the calendar, however many rows."""
    upto = Window.partitionBy(F.lit(1)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return savings_by_date(rows, pattern).select("date", "amount", F.sum("amount").over(upto).cast(TOTAL).alias("cumulative"))


def balance_trajectory(rows: DataFrame) -> DataFrame:
    """The last known balance of each account and day."""
    return rows.filter(F.col("balance").isNotNull() & F.col("date").isNotNull()).groupBy("account", "date").agg(F.max_by("balance", "ord").alias("balance"))


def by_description(rows: DataFrame) -> DataFrame:
    """Uncategorised rows by description: sum, count, and where ties come in the order of the row report."""
    first = F.min(F.struct((-F.abs("amount")).alias("size"), F.col("ord").alias("ord")))
    return rows.filter(F.col("category") == "").groupBy("description").agg(total("amount").alias("amount"), F.count("*").alias("rows"), first.alias("_first")).select("description", "amount", "rows", F.col("_first.ord").alias("first_ord"))


def triage_groups(rows: DataFrame) -> DataFrame:
    """Uncategorised descriptions with count and sum, and the first row for ties."""
    return rows.filter(F.col("category") == "").groupBy("description").agg(F.count("*").alias("rows"), total("amount").alias("amount"), F.min("ord").alias("first_ord"))


def description_account(rows: DataFrame) -> DataFrame:
    """The account of a description over all rows, `any` if it has several."""
    one = F.min("account") == F.max("account")
    return rows.groupBy("description").agg(F.when(one, F.min("account")).otherwise("any").alias("account"))


def run_counts(rows: DataFrame, inside) -> DataFrame:
    open_ = inside & ~F.col("is_transfer") & (F.col("category") == "")
    return rows.agg(F.count("*").alias("read"), F.count_if(inside).alias("in_range"), F.count_if(open_).alias("uncategorised"))
