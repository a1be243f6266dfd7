"""Order-blind collapsing against brute force."""

import datetime as dt
import random
import re
from collections import defaultdict
from decimal import Decimal

import pyarrow as pa

from tillweave.llm import fold_hash as H

SCHEMA = "ord long, account string, amount decimal(18,2), date date, description string"


def brute(rows):
    groups = defaultdict(list)
    for ord_, account, amount, date, text in rows:
        groups[account, amount, date, tuple(sorted(re.findall(r"[^\W_]+", (text or "").lower())))].append(ord_)
    return sorted((min(g), x) for g in groups.values() for x in g if x != min(g))


def test_against_brute_force(spark):
    rnd = random.Random(3)
    words = ["Alpha", "beta", "GAMMA", "7", "8", "é"]
    rows = []
    for i in range(600):
        w = [rnd.choice(words) for _ in range(rnd.randrange(0, 4))]
        text = rnd.choice([None, "", " - ", *[rnd.choice([" ", "; ", "/", "_"]).join(rnd.choice([x, x.upper(), x.lower()]) for x in w)] * 6])
        rows.append((i, rnd.choice(["a", None]), rnd.choice([Decimal("1.00"), None]), rnd.choice([dt.date(2024, 1, 1), None]), text))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as _id", "2 as _text").repartition(3)
    got = H.collapse(df)
    assert sorted((r._to, r._id) for r in got.collect()) == brute(rows)
    copies = H.with_copies(df.select("ord"), got)
    assert copies.count() == 600 - len(brute(rows)) and copies.agg({"copies": "sum"}).first()[0] == 600
    assert H.collapse(df.limit(0)).count() == 0


def test_one_group_of_most_rows_and_long_texts(spark):
    long = "w " * 40_000 + "end"
    rows = [(i, "a", Decimal("1.00"), None, "Same  TEXT") for i in range(3000)] + [(9001, "a", None, None, long), (9002, "a", None, None, "END " + long[:-3])]
    got = H.collapse(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 3000 and {(r._to, r._id) for r in got} >= {(0, 2999), (9001, 9002)}


def test_hash_and_comparison():
    a, b = H.hash_texts(pa.array(["a b", "B, a!", "ab", None, "", "a a b", "a b b"]))
    assert a[0] == a[1] != a[2] and a[3] == a[4] == 0 and a[5] != a[6] and b[0] == b[1]
    long = pa.array(["Alpha beta, gamma " * 50])
    assert H.hash_texts(long) == H.hash_texts(long, 20)
    assert H.same_words("x - Y", "y x") and not H.same_words("x x y", "x y y") and not H.same_words("ab", "a b") and H.same_words(None, "!")


def test_colliding_rows_are_told_apart(spark, monkeypatch):
    """Rows whose hashes are made to collide still form groups by their words."""
    rows = [(1, "a", None, None, "p"), (2, "a", None, None, "q"), (3, "a", None, None, "Q!"), (4, "a", None, None, "p.")]
    real = H._hashed
    from pyspark.sql import functions as F

    monkeypatch.setattr(H, "_hashed", lambda df, c: real(df, c).withColumn("_h1", F.lit(5).cast("long")).withColumn("_h2", F.lit(5).cast("long")))
    assert sorted((r._to, r._id) for r in H.collapse(spark.createDataFrame(rows, SCHEMA)).collect()) == [(1, 4), (2, 3)]
