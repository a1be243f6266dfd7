"""Streams over small Parquet files, run to their end."""

import datetime as dt
from decimal import Decimal as D

from tillweave.config.rules import Rule
from tillweave.streaming.ledger_stream import daily_spend, drop_repeats, label_stream, read_ledger_stream

SCHEMA = "ord long, date date, description string, amount decimal(18,2), balance decimal(18,2), account string, category string, subcategory string, is_transfer boolean, loaded_at timestamp_ntz"


def run(spark, df, name):
    df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def rows(n, at):
    day = dt.date(2026, 1, 1)
    return [(n, day, "COFFEE ONE", D("-4.50"), None, "a", None, None, None, at), (n + 1, day, "PAY", D("9"), None, "a", "Income", "", False, at)]


def test_labels_repeats_and_days(spark, tmp_path):
    path = str(tmp_path / "in")
    start = dt.datetime(2026, 1, 1, 10)
    for k in range(3):
        spark.createDataFrame(rows(10 * k, start + dt.timedelta(days=20 * k)), SCHEMA).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    stream = lambda: read_ledger_stream(spark, path, schema, 1)
    labelled = run(spark, label_stream(stream(), [Rule("prefix", "COFFEE", "Food/Out")]), "labelled")
    assert sorted({(r.description, r.category, r.subcategory, r.is_transfer) for r in labelled}) == [("COFFEE ONE", "Food", "Out", False), ("PAY", "", "", False)]
    kept = run(spark, drop_repeats(stream(), "30 days"), "kept")
    assert sorted(r.description for r in kept) == ["COFFEE ONE", "PAY"]
    days = run(spark, daily_spend(stream(), "1 day"), "days")
    assert {(r.day.day, r.amount, r.rows) for r in days} <= {(1, D("4.50"), 1), (21, D("4.50"), 1), (10, D("4.50"), 1)} and len(days) >= 2
