"""Queries that run the streaming operators to their end over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillweave.functions.columns import wall_time
from tillweave.plans.ledger_views import sql
from tillweave.plans.registry import query
from tillweave.session import shared_dir
from tillweave.streaming.ledger_stream import daily_spend, read_ledger_stream


@query("stream_daily_spend", sql("""select date_trunc('day', v.loaded_at)::timestamp as day, l.account, l.category, sum(-l.amount)::decimal(38,2) as amount, count(*) as "rows" from led l join ledger v on v.ord = l.ord
  where not l.is_transfer and l.amount < 0 and v.loaded_at is not null group by 1, 2, 3"""))
def stream_daily_spend(spark, sf_dir):
    """All files are taken in one batch, so nothing is late, and the totals are complete when it ends."""
    schema = spark.read.parquet(f"{sf_dir}/ledger.parquet").schema
    rows = read_ledger_stream(spark, f"{sf_dir}/ledger.parque[t]", schema)
    out = shared_dir(spark, "stream")
    name = f"daily_{uuid.uuid4().hex[:8]}"
    run = daily_spend(rows).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{out}/state").queryName(name)
    run.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{out}/rows")).start().awaitTermination()
    parts = spark.read.parquet(f"{out}/rows")
    last = parts.groupBy("day", "account", "category").agg(F.max_by(F.struct("amount", "rows"), "batch").alias("_v"))
    return last.select(wall_time(F.col("day")).alias("day"), "account", "category", "_v.amount", "_v.rows")
