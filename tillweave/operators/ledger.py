"""The typed ledger all reports read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXTS = ("description", "currency", "category", "subcategory")


def normalise(rows: DataFrame) -> DataFrame:
    """Blank texts and absent flags get their defaults; other columns go through as they are."""
    filled = {c: F.coalesce(F.col(c), F.lit("")) for c in TEXTS if c in rows.columns}
    if "is_transfer" in rows.columns:
        filled["is_transfer"] = F.coalesce(F.col("is_transfer"), F.lit(False))
    return rows.withColumns(filled)
