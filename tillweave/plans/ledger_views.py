"""The ledger view of the driver's tables, in Spark and as SQL, and helpers for the queries on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillweave.operators.ledger import normalise
from tillweave.session import table

FIRST, LAST = "2023-04-01", "2024-03-31"
MIN_SHARE, MIN_SHARE_SUB = "0.03", "0.01"

COLUMNS = ["ord", "date", "description", "amount", "balance", "currency", "account", "source_file", "page", "row", "category", "subcategory", "is_transfer"]

LEDGER_SQL = """
with led as (select ord, date, coalesce(description, '') description, amount, balance, coalesce(currency, '') currency, account, source_file, page, "row",
  coalesce(category, '') category, coalesce(subcategory, '') subcategory, coalesce(is_transfer, false) is_transfer from ledger),
rng as (select * from led where date between date '2023-04-01' and date '2024-03-31')
"""
T = "decimal(38,2)"


def led(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(table(spark, sf_dir, "ledger").select(COLUMNS))


def sql(body: str, *ctes: str) -> str:
    """A query over led (the view) and rng (its rows in the date range)."""
    return LEDGER_SQL + "".join(f", {c}" for c in ctes) + "\n" + body
