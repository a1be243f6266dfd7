"""Netting, flows, integrity, periods: goldens and properties against sequential models."""

import datetime as dt
import random
import re
import time
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tillweave.config.rules import Rule, required_literal
from tillweave.operators import categorise, flows, integrity, netting, reports
from tillweave.operators.dyadic import periods_and_gaps

LEG = "ord long, date date, amount decimal(18,2), account string, is_transfer boolean"


def legs(spark, rows):
    return spark.createDataFrame([(i, d and dt.date.fromisoformat(d), D(a), acc, True) for i, (d, a, acc) in enumerate(rows)], LEG)


@pytest.mark.parametrize(
    "rows, pairs",
    [
        ([("2025-06-02", "-71.2", "tern"), ("2025-06-02", "71.2", "knot")], [0, 0]),
        ([("2024-02-28", "33", "knot"), ("2024-03-01", "-33", "tern")], [0, 0]),
        ([("2025-06-02", "-33", "tern"), ("2025-06-06", "33", "knot")], [None, None]),
        ([("2025-06-02", "-33", "tern"), ("2025-06-02", "33.01", "knot"), ("2025-06-02", "33", "tern")], [None] * 3),
        ([("2025-06-05", "33", "knot"), ("2025-06-02", "-33", "tern"), ("2025-06-03", "33", "auk")], [None, 0, 0]),
        ([(None, "-33", "tern"), ("2025-06-02", "33", "knot"), ("2025-06-02", "0", "auk")], [None] * 3),
    ],
)
def test_netting_goldens(spark, rows, pairs):
    net = netting.net_transfers(legs(spark, rows))
    assert [r.pair_id for r in net.orderBy("ord").collect()] == pairs
    assert netting.unmatched(net).count() == pairs.count(None)


def greedy(rows, window):
    cand = []
    for i, (d, a, acc) in enumerate(rows):
        for j in range(i + 1, len(rows)):
            e, b, other = rows[j]
            if d and e and D(a) == -D(b) != 0 and acc != other:
                delta = abs((dt.date.fromisoformat(d) - dt.date.fromisoformat(e)).days)
                if delta <= window:
                    cand.append((delta, i, j))
    used, out = set(), []
    for c in sorted(cand):
        if not used & set(c[1:]):
            used |= set(c[1:])
            out.append(c)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_netting_equals_greedy(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice([str(dt.date(2026, 1, 1) + dt.timedelta(rnd.randrange(20))), None, str(dt.date(2026, 3, 1))]), rnd.choice(["5", "-5", "7", "-7", "0"]), rnd.choice("ABC")) for _ in range(120)]
    for window in (0, 1, 3):
        got = netting.transfer_pairs(legs(spark, rows), window)
        assert sorted(map(tuple, got.collect())) == greedy(rows, window)


def test_a_hot_amount_is_netted_in_one_pass(spark):
    """100,000 legs of one amount on one day: all debits first, so every leg waits before it is closed."""
    began = time.perf_counter()
    n = 100_000
    rows = spark.range(n).select(F.col("id").alias("ord"), F.lit(dt.date(2025, 6, 2)).alias("date"), F.when(F.col("id") < n // 2, -9).otherwise(9).cast("decimal(18,2)").alias("amount"), F.concat(F.lit("a"), F.col("id") % 7).alias("account"), F.lit(True).alias("is_transfer"))
    got = netting.transfer_pairs(rows)
    sums = got.agg(F.count("*").alias("n"), F.countDistinct("i").alias("i"), F.countDistinct("j").alias("j")).first()
    assert sums.n == sums.i == sums.j > 49_000 and time.perf_counter() - began < 60


def runs(intervals):
    days = sorted({a + dt.timedelta(k) for a, b in intervals for k in range((b - a).days + 1)})
    out, start = [], days[0]
    for x, y in zip(days, [*days[1:], None]):
        if y is None or (y - x).days > 1:
            out.append(("period", start, x))
            if y:
                out.append(("gap", x + dt.timedelta(1), y - dt.timedelta(1)))
                start = y
    return out


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_periods_against_day_sets(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rnd = random.Random(2)
    rows, want = [], []
    for account in ["a", "b", "c", None]:
        own = []
        for _ in range(rnd.randrange(1, 25)):
            a = dt.date(2023, 12, 20) + dt.timedelta(rnd.randrange(300))
            own.append((a, a + dt.timedelta(rnd.choice([0, 1, 5, 30]))))
        rows += [(account, a, b, 1) for a, b in own + own[:2]] + [(account, None, own[0][1], 1), (account, own[0][1] + dt.timedelta(1), own[0][0], 1)]
        want += [(account, k, str(a), str(b)) for k, a, b in runs(own)]
    df = spark.createDataFrame(rows, "account string, period_start date, period_end date, level int")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, periods_and_gaps(df).collect()), key=key) == sorted(want, key=key)
    assert periods_and_gaps(df.limit(0)).count() == 0
    edge = spark.createDataFrame([("x", dt.date(1, 1, 1), dt.date(9999, 12, 31), 0)], df.schema)
    assert [tuple(r) for r in periods_and_gaps(edge).collect()] == [("x", "period", "0001-01-01", "9999-12-31")]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_fill_and_continuity_against_a_loop(spark):
    rnd = random.Random(4)
    rows, fills, bad = [], {}, set()
    for f in ("p", "q"):
        carried = None
        for n in range(60):
            amount, printed = D(rnd.randrange(-500, 500)) / 100, None
            truth = (carried or D(0)) + amount
            if rnd.random() < 0.5 and n > 3:
                printed = truth + rnd.choice([D(0), D(0), D("0.01"), D("0.02")])
                if carried is not None and abs(carried + amount - printed) > D("0.01"):
                    bad.add((f, n))
            carried = printed if printed is not None else None if carried is None else carried + amount
            fills[f, n] = carried
            rows.append((f, n, amount, printed))
    df = spark.createDataFrame(rows, "source_file string, row int, amount decimal(18,2), balance decimal(18,2)")
    assert {(r.source_file, r.row): r.balance for r in integrity.balance_forward(df).collect()} == fills
    assert {(r.source_file, r.row) for r in integrity.balance_violations(df).collect()} == bad


def test_dedupe_keeps_the_first_and_nulls_are_equal(spark):
    rows = [(2, None, "x", D(1), None, "a"), (1, None, "x", D(1), None, "a"), (3, None, "x", D(1), D(5), "a")]
    df = spark.createDataFrame(rows, "ord long, date date, description string, amount decimal(18,2), balance decimal(18,2), account string")
    assert sorted(r.ord for r in integrity.dedupe(df).collect()) == [1, 3]


def test_first_match_wins_and_patterns_are_literal(spark):
    rules = [Rule("contains", "50%", "Sale"), Rule("prefix", "A_", "Under/Score", account="x"), Rule("regex", r"^(?P<who>\w+)? ?PAY$", "Pay", extract="who"), Rule("contains", "", "Never")][:3]
    df = spark.createDataFrame([(1, "at 50% off", "x"), (2, "A_B", "x"), (3, "A_B", "y"), (4, "AxB", "x"), (5, "BOB PAY", "x"), (6, "PAY", "x"), (7, None, "x"), (8, "at 505 off", "x")], "ord long, description string, account string")
    got = {r.ord: (r.category, r.subcategory) for r in categorise.categorise(df, rules).collect()}
    assert got == {1: ("Sale", ""), 2: ("Under", "Score"), 3: ("", ""), 4: ("", ""), 5: ("Pay", "BOB"), 6: ("Pay", ""), 7: ("", ""), 8: ("", "")}
    assert {r.category for r in categorise.categorise(df, []).collect()} == {""}


def test_rules_of_a_table_are_applied_in_order_whatever_their_kind(spark):
    """Against each rule tried on each row in turn; patterns with a long, a short and no certain text."""
    patterns = [r"^ACME FUELS\s+(?P<place>[A-Z ]+)$", r"SHOP\s\d{4}", r"(?i)\bcinema\b", r"^X\d+$", r"\d{3}[A-Z]{2}", r"(?:TAXI|TRAM)", r"(?:PUB )+Q?", r"CAFE?", r"^$"]
    rules = [Rule("regex", p, "C", a) for p in patterns for a in ("any", "y")] + [Rule("contains", "ACME", "C"), Rule("exact", "SHOP 1234", "C"), Rule("prefix", "X", "C", "x"), Rule("contains", "", "C")]
    random.Random(5).shuffle(rules)
    rows = [(i, d, a) for i, (d, a) in enumerate((d, a) for d in ["ACME FUELS CORK", "ACME FUELS 7", "SHOP 1234", "MY SHOP 12345", "THE Cinema X", "X12", "X", "AT 123IE", "TAXI", "A TRAM", "PUB PUB ", "CAF", "CAFE", "CA", "", None] for a in ("x", "y"))]
    kinds = {"exact": lambda r, d: d == r.pattern, "contains": lambda r, d: r.pattern in d, "prefix": lambda r, d: d.startswith(r.pattern), "regex": lambda r, d: re.search(r.pattern, d)}
    want = {}
    for i, d, a in rows:
        fits = [k for k, r in enumerate(rules) if r.pattern and r.account in ("any", a) and kinds[r.match](r, d or "")]
        if fits:
            want[i] = fits[0]
    table = spark.createDataFrame([(k, k, r.match, r.pattern, r.account) for k, r in enumerate(rules)], "rule_id long, idx int, match string, pattern string, account string")
    got = categorise.categorise_by_table(spark.createDataFrame(rows, "ord long, description string, account string"), table)
    assert {r.ord: r.rule_id for r in got.collect()} == want


def test_required_literal():
    certain = {r"^ACME FUELS\s+(?P<place>[A-Z ]+)$": "ACME FUELS", r"(?i)cinema": "", r"(?i:cin)ema": "ema", r"CAFE?": "CAF", r"AB|CD": "", r"(?:PUB )+Q?": "PUB ", r"(?:PUB )*Q": "Q", r"A(?!BCD)": "A", r"(?x) A B": "AB"}
    assert {p: required_literal(p) for p in certain} == certain


ROW = "ord long, date date, description string, amount decimal(18,2), account string, category string, subcategory string, is_transfer boolean, currency string"


def frame(spark, n, seed):
    rnd = random.Random(seed)
    rows = [
        (i, dt.date(2026, 1, 1) + dt.timedelta(rnd.randrange(90)), f"d{rnd.randrange(9)}", D(rnd.randrange(-3000, 3000)) / 100, rnd.choice("AB"), rnd.choice(["", "Food", "Rent", "Other", "Tiny"]), rnd.choice(["", "x", "y"]), rnd.random() < 0.3, rnd.choice(["EUR", " "]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, ROW)


def test_flows_are_conserved(spark):
    net = netting.net_transfers(frame(spark, 300, 1))
    links = flows.all_links(net, "0.05", "0.02")
    total = lambda df, c: df.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0]
    debit = (~F.col("is_transfer") | F.col("pair_id").isNull()) & (F.col("amount") < 0)
    credit = (~F.col("is_transfer") | F.col("pair_id").isNull()) & (F.col("amount") > 0)
    assert total(links.filter("source_layer = 'account' and target_layer <> 'account'"), "value") == -total(net.filter(debit), "amount")
    assert total(links.filter("source_layer <> 'account' and target_layer = 'account'"), "value") == total(net.filter(credit), "amount")
    months = reports.month_grid(net)
    assert total(months, "amount") == -total(net.filter("not is_transfer and amount < 0"), "amount")


def test_empty_frames(spark):
    none = frame(spark, 1, 0).limit(0)
    net = netting.net_transfers(none)
    assert net.count() == 0 and flows.all_links(net).count() == 0
    tiles = reports.stat_tiles(none).first()
    assert (tiles.income, tiles.spend, tiles.savings_rate, tiles.currency) == (0, 0, None, None)
    assert reports.month_delta(none).count() == reports.savings_cumulative(none, "x").count() == 0


def test_shares_fold_strictly_below(spark):
    rows = [(i, dt.date(2026, 1, 1), "d", D(-a), "A", c, s, False, "EUR") for i, (a, c, s) in enumerate([(90, "Big", "x"), (9, "Nine", ""), (1, "One", "")])]
    shown = {r.label: r.shown for r in flows.spend_labels(spark.createDataFrame(rows, ROW), "0.09").collect()}
    assert shown == {"Big": "Big", "Nine": "Nine", "One": "Other"}


def test_month_gaps_and_movers(spark):
    rows = [(1, dt.date(2026, 1, 5), "d", D(-10), "A", "Food", "", False, "EUR"), (2, dt.date(2026, 3, 5), "d", D(-4), "A", "Food", "", False, "EUR"), (3, dt.date(2026, 3, 6), "d", D(-7), "A", "", "", False, "EUR")]
    df = spark.createDataFrame(rows, ROW)
    assert {(r.month, r.category): r.delta for r in reports.month_delta(df).collect()} == {("2026-01", "Food"): None, ("2026-01", "(uncategorised)"): None, ("2026-03", "Food"): D(-6), ("2026-03", "(uncategorised)"): D(7)}
    assert reports.prior_window("2026-03-01", "2026-03-31") == ("2026-01-29", "2026-02-28")
    moved = {r.category: r.delta for r in reports.movers(df, "2026-02-01", "2026-03-31").collect()}
    assert moved == {"Food": D(-6), "(uncategorised)": D(7)}
