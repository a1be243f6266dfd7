"""Coercion of raw rows into canonical ones, and the checks on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillweave.config.profile import Profile
from tillweave.config.strategies import AMOUNT_STYLES, DATE_FILLS
from tillweave.functions.columns import MONEY, date_is_bad, money_is_bad, parse_date, parse_money

TOLERANCE = "0.01"
KEYS = ("date", "description", "amount", "balance", "account")


def _file(*order: str):
    return Window.partitionBy("source_file").orderBy(*(order or ("row",)))


def date_forward(date: Column | str, order: str = "row") -> Column:
    """The last date at or before a row of its file; leading blanks stay null."""
    return DATE_FILLS["forward"](date, order)


def balance_forward(rows: DataFrame, order: str = "row") -> DataFrame:
    """rows with absent balances computed from the last printed one and the amounts since."""
    run = _file(order)
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_run", F.count("balance").over(upto))
    own = Window.partitionBy("source_file", "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    since = F.sum(F.when(F.col("balance").isNull(), F.col("amount")).otherwise(F.lit(0))).over(own)
    filled = F.when(F.col("_run") > 0, F.first("balance", ignorenulls=True).over(own) + since)
    return marked.withColumn("balance", filled.cast(MONEY)).drop("_run")


def coerce(raw: DataFrame, profile: Profile) -> DataFrame:
    """Canonical rows of raw text rows (source_file, page, row and the profile's fields).

    Dates and their fill come first, then amounts, then balances, and only then the rows to skip, so a
    skipped row still hands its date and balance on. Cells that can't be read are flagged in _bad.
    """
    fields = profile.fields
    text = {f: F.coalesce(F.col(f), F.lit("")) for f in fields}
    number = lambda f: parse_money(text[f], profile.thousands, profile.decimal)
    bad_number = lambda f: money_is_bad(text[f], profile.thousands, profile.decimal)
    numeric = [f for f in ("amount", "in", "out", "balance") if f in fields]
    bad = date_is_bad(text["date"], profile.date_format)
    for f in numeric:
        bad = bad | bad_number(f)
    amount, lacking = AMOUNT_STYLES[profile.style](number)
    bad = bad | lacking
    date = parse_date(text["date"], profile.date_format)
    skipped = F.lit(False)
    for f, value in profile.skip:
        skipped = skipped | (text[f] == F.lit(value))
    typed = raw.select(
        date.alias("date"),
        F.trim(text["description"]).alias("description"),
        amount.cast(MONEY).alias("amount"),
        (number("balance") if profile.has_balance else F.lit(None).cast(MONEY)).alias("balance"),
        (F.nullif(F.trim(text["currency"]), F.lit("")) if "currency" in fields else F.lit(None).cast("string")).alias("currency"),
        F.lit(profile.name).alias("account"),
        "source_file",
        "page",
        "row",
        bad.alias("_bad"),
        skipped.alias("_skip"),
    )
    typed = typed.withColumn("date", DATE_FILLS[profile.date_fill]("date", "row"))
    if profile.has_balance:
        typed = balance_forward(typed)
    return typed.filter(~F.col("_skip")).drop("_skip")


def balance_violations(rows: DataFrame, order: str = "row") -> DataFrame:
    """Rows whose printed balance is off by more than a cent, with what was expected.

    Rows without a balance carry the running sum on; the first row of a file that has one only starts it.
    """
    carried = balance_forward(rows.withColumn("printed", F.col("balance")), order)
    expected = (F.lag("balance").over(_file(order)) + F.col("amount")).cast(MONEY)
    checked = carried.withColumn("expected", expected).filter(F.col("printed").isNotNull() & F.col("expected").isNotNull())
    return checked.filter(F.abs(F.col("expected") - F.col("printed")) > F.lit(TOLERANCE).cast(MONEY)).drop("balance")


def dedupe(rows: DataFrame, order: str = "ord", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The first row of each set of equal keys, null equal to null.

    The smallest order of a set is an aggregate with map-side partials, so a record repeated many million
    times costs its task one row per map task; order must be unique.
    """
    first = rows.groupBy(*keys).agg(F.min(order).alias(order)).select(order)
    return rows.join(first, order, "left_semi")


def source_periods(rows: DataFrame) -> DataFrame:
    """First and last date of each file, by account, with the place of its first row."""
    return rows.filter(F.col("date").isNotNull()).groupBy("account", "source_file").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.min("ord").alias("first_ord"))


def period_warnings(periods: DataFrame) -> DataFrame:
    """Gaps and overlaps of each account's files with the one that starts right before."""
    by_start = Window.partitionBy("account").orderBy("start", "first_ord")
    step = periods.select("account", "source_file", "start", F.lag("end").over(by_start).alias("previous_end"), F.lag("source_file").over(by_start).alias("previous_file"))
    kind = F.when(F.col("start") > F.date_add("previous_end", 1), "gap").when(F.col("start") <= F.col("previous_end"), "overlap")
    return step.withColumn("kind", kind).filter(F.col("kind").isNotNull())
