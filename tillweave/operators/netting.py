"""Pairing the two legs of transfers between accounts: greedy by closeness, each row once.

Candidates are taken in the order (days apart, smaller ord, larger ord). For one distance in days this is the
same as reading the legs by ord and giving each the earliest open leg it may pair with, or leaving it open: the
smallest open leg takes the first that fits, and nothing before that could have taken either. So no candidate is
ever listed. Legs of the same day are read by amount and day; those left over, by amount and run of days, once for
each distance. Open legs wait in queues by account, of which the two with the earliest heads are looked at.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillweave.operators.numbering import numbered
from tillweave.session import written

WINDOW_DAYS = 3
_LEFT = -1


def eligible(rows: DataFrame) -> DataFrame:
    """Dated transfer rows with an amount, by absolute amount and side."""
    keep = F.col("is_transfer") & F.col("date").isNotNull() & (F.col("amount") != 0) & F.col("account").isNotNull()
    return rows.filter(keep).select("ord", "date", "account", F.abs("amount").alias("k"), (F.col("amount") > 0).alias("credit"))


def candidates(rows: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """(k, delta, i, j) with i < j: opposite signs, equal absolute amounts, other accounts, few days apart.

    The report of all candidates; the matching itself never lists them. An equi-join on amount and day (one
    side is copied to the days of its window), so hot amounts spread over their days.
    """
    legs = eligible(rows)
    days = F.explode(F.sequence(F.date_sub("date", window_days), F.date_add("date", window_days)))
    debit = legs.filter(~F.col("credit")).select("k", F.col("ord").alias("a"), F.col("account").alias("account_a"), F.col("date").alias("date_a"), days.alias("day"))
    credit = legs.filter("credit").select("k", F.col("ord").alias("b"), F.col("account").alias("account_b"), F.col("date").alias("day"))
    met = debit.join(credit, ["k", "day"]).filter("account_a <> account_b")
    return met.select("k", F.abs(F.datediff("day", "date_a")).alias("delta"), F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), F.least("day", "date_a").alias("first_day"))


class OpenLegs:
    """Open legs of one day and side, by ord within each account."""

    def __init__(self) -> None:
        self.queues: dict[str, deque[int]] = {}
        self.heads: list[tuple[int, str]] = []

    def add(self, ord_: int, account: str) -> None:
        queue = self.queues.setdefault(account, deque())
        if not queue:
            heappush(self.heads, (ord_, account))
        queue.append(ord_)

    def first_of_others(self, account: str) -> tuple[int, str] | None:
        """The earliest open leg of another account."""
        if not self.heads:
            return None
        if self.heads[0][1] != account:
            return self.heads[0]
        # The second smallest of a heap is one of the children of its root.
        return min(self.heads[1:3], default=None)

    def take(self, account: str) -> None:
        """Close the earliest leg of account."""
        queue = self.queues[account]
        head = (queue.popleft(), account)
        first = heappop(self.heads)
        if first != head:  # then head is the second smallest
            heappop(self.heads)
            heappush(self.heads, first)
        if queue:
            heappush(self.heads, (queue[0], account))
        else:
            del self.queues[account]


class LegMatcher:
    """Greedy matching of legs that come by ord, for one distance in days."""

    def __init__(self, delta: int) -> None:
        self.delta = delta
        self.open: dict[tuple[int, bool], OpenLegs] = {}

    def offer(self, ord_: int, day: int, credit: bool, account: str) -> int | None:
        """The open leg that this one closes; None if it stays open itself."""
        best = None
        for at in {day - self.delta, day + self.delta}:
            place = self.open.get((at, not credit))
            found = place.first_of_others(account) if place else None
            if found and (best is None or found < best[0]):
                best = (found, place)
        if best is None:
            self.open.setdefault((day, credit), OpenLegs()).add(ord_, account)
            return None
        best[1].take(best[0][1])
        return best[0][0]


def _by_group(batches: Iterator[pa.RecordBatch], keys: list[str], start: Callable, end: Callable) -> Iterator[pa.RecordBatch]:
    """Streams sorted rows group by group: state = start(); state(row part) for each part; end(state) yields batches."""
    held, state = None, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        change = np.zeros(n, bool)
        change[0] = True
        for name in keys:
            c = batch.column(name)
            if n > 1:
                change[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        cuts = [*np.flatnonzero(change).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(batch.column(k)[a].as_py() for k in keys)
            if state is not None and key != held:
                yield from end(state)
                state = None
            if state is None:
                held, state = key, start()
            yield from state(batch.slice(a, b - a))
    if state is not None:
        yield from end(state)


_PAIRS = "delta int, i long, j long"


def _frame(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    d, i, j = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(i, pa.int64()), pa.array(j, pa.int64())], names=["delta", "i", "j"])


def _columns(part: pa.RecordBatch) -> Iterator[tuple[int, int, bool, str]]:
    return zip(*(part.column(c).to_pylist() for c in ("ord", "day", "credit", "account")))


def _same_day(legs: DataFrame) -> DataFrame:
    """(delta, i, j) of pairs within a day, and (-1, ord, null) of the legs left over. Legs stream through.

    What is held is an integer for each leg that is open, so at most the legs of one amount and day.
    """

    def start() -> Callable:
        matcher = LegMatcher(0)

        def take(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            pairs = []
            for ord_, day, credit, account in _columns(part):
                other = matcher.offer(ord_, day, credit, account)
                if other is not None:
                    pairs.append((0, other, ord_))
            yield _frame(pairs)

        take.matcher = matcher
        return take

    def end(take: Callable) -> Iterator[pa.RecordBatch]:
        left = [o for place in take.matcher.open.values() for queue in place.queues.values() for o in queue]
        yield _frame([(_LEFT, o, None) for o in left])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_group(batches, ["k", "day"], start, end)

    return legs.repartition("k", "day").sortWithinPartitions("k", "day", "ord").mapInArrow(run, _PAIRS)


def _other_days(legs: DataFrame, window_days: int) -> DataFrame:
    """(delta, i, j) of pairs one day and more apart, group by group; a group's legs left over are held in its task."""

    def start() -> Callable:
        held: list[tuple] = []

        def take(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            held.extend(_columns(part))
            return iter(())

        take.held = held
        return take

    def end(take: Callable) -> Iterator[pa.RecordBatch]:
        legs = take.held
        for delta in range(1, window_days + 1):
            matcher, pairs, gone = LegMatcher(delta), [], set()
            for leg in legs:
                other = matcher.offer(*leg)
                if other is not None:
                    pairs.append((delta, other, leg[0]))
                    gone |= {other, leg[0]}
            legs = [leg for leg in legs if leg[0] not in gone]
            yield _frame(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_group(batches, ["k", "cluster"], start, end)

    return legs.repartition("k", "cluster").sortWithinPartitions("k", "cluster", "ord").mapInArrow(run, _PAIRS)


def _clusters(legs: DataFrame, window_days: int) -> DataFrame:
    """legs with cluster: days of one amount without a gap wider than the window. Days, not rows, are ordered.

    Clusters with legs of one side, or of one account, hold no pair and are left out.
    """
    by_day = Window.partitionBy("k").orderBy("day")
    days = legs.groupBy("k", "day").agg(F.bool_or("credit").alias("_c"), F.bool_or(~F.col("credit")).alias("_d"), F.min("account").alias("_a"), F.max("account").alias("_z"))
    gap = F.coalesce(F.col("day") - F.lag("day").over(by_day), F.lit(0)) > window_days
    marked = days.withColumn("_gap", gap.cast("int")).withColumn("cluster", F.sum("_gap").over(by_day.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("k", "cluster")
    useful = F.max("_c").over(whole) & F.max("_d").over(whole) & (F.min("_a").over(whole) != F.max("_z").over(whole))
    return legs.join(marked.withColumn("_useful", useful).filter("_useful").select("k", "day", "cluster"), ["k", "day"])


def transfer_pairs(rows: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """(delta, i, j) of the accepted pairs: candidates in the order (delta, i, j), each row once.

    ord must be unique. Undated and zero rows, and those without an account, pair with none; an empty table has
    no pairs; extra columns are ignored.
    """
    legs = eligible(rows).select("k", F.unix_date("date").alias("day"), "ord", "credit", "account")
    first = written(_same_day(legs), "net-day")
    same = first.filter(f"delta <> {_LEFT}")
    if not window_days:
        return same
    left = legs.join(first.filter(f"delta = {_LEFT}").select(F.col("i").alias("ord")), "ord", "left_semi")
    return same.unionByName(_other_days(_clusters(written(left, "net-left"), window_days), window_days))


def net_transfers(rows: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """rows with pair_id, numbered from 0 in the order pairs were claimed; null where unpaired."""
    pairs = numbered(transfer_pairs(rows, window_days), ["delta", "i", "j"], "pair_id")
    ends = pairs.select("pair_id", F.explode(F.array("i", "j")).alias("ord"))
    return rows.join(ends, "ord", "left")


def unmatched(netted: DataFrame) -> DataFrame:
    """Transfer rows without a partner, undated and zero ones among them, in their original columns."""
    return netted.filter(F.col("is_transfer") & F.col("pair_id").isNull()).drop("pair_id")
