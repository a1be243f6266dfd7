"""Numbering rows in a total order without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillweave.session import written


def _offsets(spark: SparkSession, counts: dict[int, int]) -> DataFrame:
    """(part, before): the rows in the partitions before each, as a table of one row for each partition."""
    before, rows = 0, []
    for part in sorted(counts):
        rows.append((part, before))
        before += counts[part]
    return spark.createDataFrame(rows, "part long, before long")


def numbered(df: DataFrame, order: list, name: str, start: int = 0) -> DataFrame:
    """df with name, the rank of each row in order, counted from start.

    Rows are sorted by range; the place in its partition and the rows of the partitions before give the rank.
    What comes to the driver is one count for each partition, and goes back as a table that is broadcast: two
    integers for each partition, whatever the number of rows.
    """
    place = F.monotonically_increasing_id()
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(sorted_.withColumns({"_part": F.shiftright(place, 33), "_spot": place.bitwiseAND((1 << 33) - 1)}), "numbered")
    counts = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    offsets = F.broadcast(_offsets(df.sparkSession, counts))
    rank = (F.col("_spot") + F.col("before") + start).alias(name)
    return placed.join(offsets, placed["_part"] == offsets["part"]).select(*df.columns, rank)
