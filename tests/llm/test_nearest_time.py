"""The trie pairing against brute force."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from tillweave.llm.nearest_time import _split_hot, match_nearest, micros

HOUR = 3_600_000_000
EPOCH = dt.datetime(2024, 1, 1)


def brute(left, right, tolerance):
    out = []
    for k, i, t in left:
        near = [(abs((t - u).total_seconds()), j) for m, j, u in right if None not in (k, t, u) and m == k and abs(t - u) <= tolerance]
        if near:
            out.append((i, min(near)[1]))
    return sorted(out)


@pytest.mark.parametrize("trie_rows, split_rows", [(3, 1_000_000), (7, 5), (1 << 15, 2)])
def test_against_brute_force(spark, trie_rows, split_rows):
    rnd = random.Random(trie_rows)
    stamp = lambda: EPOCH + dt.timedelta(hours=rnd.randrange(0, 900), seconds=rnd.choice([0, 0, 30]))
    key = lambda: rnd.choice(["hot", "hot", "hot", "a", "b", None])
    left = [(key(), i, rnd.choice([stamp(), stamp(), None])) for i in range(400)]
    right = [(key(), 1000 + i, rnd.choice([stamp(), stamp(), stamp(), None])) for i in range(250)]
    right += right[:20]
    a = spark.createDataFrame(left, "k string, i long, t timestamp_ntz").repartition(3)
    b = spark.createDataFrame(right, "k string, i long, t timestamp_ntz").selectExpr("*", "1 as _id", "2 as _bucket")
    got = match_nearest(a, b, ("k",), "i", "t", "i", "t", 48 * HOUR, trie_rows=trie_rows, split_rows=split_rows).collect()
    assert sorted(map(tuple, got)) == brute(left, right, dt.timedelta(hours=48))


def test_a_hot_entity_with_many_candidates_is_split(spark):
    """Many entries and legs of one entity within hours, a crowd of legs at one moment: no group stays large."""
    rnd = random.Random(8)
    second = lambda: EPOCH + dt.timedelta(seconds=rnd.randrange(0, 40_000))
    left = [("hot", i, rnd.choice([second(), EPOCH + dt.timedelta(hours=5)])) for i in range(700)]
    right = [("hot", 1000 + i, second()) for i in range(900)] + [("cold", 5000, EPOCH)]
    a, b = (spark.createDataFrame(rows, "k string, i long, t timestamp_ntz") for rows in (left, right))
    got = match_nearest(a, b, ("k",), "i", "t", "i", "t", 48 * HOUR, split_rows=100)
    assert sorted(map(tuple, got.collect())) == brute(left, right, dt.timedelta(hours=48))
    slim = lambda df, side: df.select(F.col("k"), F.lit(0).alias("_bucket"), F.col("i").alias("_id"), micros(df, "t").alias("_t"), F.lit(side).cast("byte").alias("_side"))
    entries, legs = _split_hot(slim(b, 0), slim(a, 1), ["k", "_bucket"], 100)
    sizes = entries.groupBy("k", "_part", "_salt").count().agg({"count": "max"}).first()[0], legs.groupBy("k", "_part", "_salt").count().agg({"count": "max"}).first()[0]
    assert sizes[0] < 30 and sizes[1] <= 140


def test_ties_and_empty_tables(spark):
    t = dt.datetime(2024, 5, 1, 12)
    a = spark.createDataFrame([("x", 1, t), ("x", 1, t)], "k string, i long, t timestamp_ntz")
    b = spark.createDataFrame([("x", 9, t + dt.timedelta(hours=2)), ("x", 7, t - dt.timedelta(hours=2)), ("x", 3, t + dt.timedelta(hours=48, microseconds=1))], a.schema)
    assert [tuple(r) for r in match_nearest(a, b, ("k",), "i", "t", "i", "t", 48 * HOUR).collect()] == [(1, 7), (1, 7)]
    assert match_nearest(a, b.limit(0), ("k",), "i", "t", "i", "t", 48 * HOUR).count() == 0
    assert match_nearest(a.limit(0), b, ("k",), "i", "t", "i", "t", 48 * HOUR).count() == 0


def test_zone_of_the_session_does_not_matter(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Dublin")
    try:
        times = [dt.datetime(2024, 3, 31, 0, 59, 59, 123456), dt.datetime(2024, 3, 31, 1, 30), dt.datetime(1969, 12, 31, 23, 59, 59, 5)]
        df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
        got = [r[0] for r in df.select(micros(df, "t")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [round((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)) for t in times]
