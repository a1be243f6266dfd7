"""The ledger as a stream: categorise rows as they come, keep running totals, drop repeated records.

An extension beyond batch reports. Every operator takes a streaming (or batch) DataFrame with `loaded_at`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, TimestampNTZType

from tillweave.config.rules import Rule
from tillweave.functions.columns import TOTAL, is_spend, wall_micros
from tillweave.operators.categorise import first_match
from tillweave.operators.ledger import normalise


def read_ledger_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files under path, a bounded number for each batch; times without a zone are taken as UTC."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    if isinstance(schema["loaded_at"].dataType, TimestampNTZType):
        rows = rows.withColumn("loaded_at", F.timestamp_micros(wall_micros(F.col("loaded_at"))))
    return rows


def label_stream(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """Category and subcategory by the first rule that fits: stateless, so no join and no shuffle."""
    names = F.array(*(F.struct(F.lit(r.path[0]).alias("category"), F.lit(r.path[1]).alias("subcategory"), F.lit(r.transfer).alias("is_transfer")) for r in rules))
    found = F.get(names, F.nullif(first_match(rules), F.lit(-1)))
    plain = rows.drop("category", "subcategory", "is_transfer")
    return normalise(plain).withColumn("_r", found).select(
        *plain.columns, F.coalesce("_r.category", F.lit("")).alias("category"), F.coalesce("_r.subcategory", F.lit("")).alias("subcategory"), F.coalesce("_r.is_transfer", F.lit(False)).alias("is_transfer")
    )


def drop_repeats(rows: DataFrame, late: str = "7 days") -> DataFrame:
    """The first of records with equal account, date, description, amount and balance within the watermark."""
    keys = ["account", "date", "description", "amount", "balance"]
    return rows.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(keys)


def daily_spend(rows: DataFrame, late: str = "7 days") -> DataFrame:
    """Spend by day of loading, account and category; a day is final once the watermark has passed it."""
    day = F.window("loaded_at", "1 day")
    totals = normalise(rows).withWatermark("loaded_at", late).filter(is_spend()).groupBy(day.alias("w"), "account", "category")
    return totals.agg(F.sum(-F.col("amount")).cast(TOTAL).alias("amount"), F.count("*").alias("rows")).select(F.col("w.start").alias("day"), "account", "category", "amount", "rows")
