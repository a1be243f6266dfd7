"""Continuous periods and gaps from overlapping intervals, by dyadic blocks.

Every interval of days is cut into canonical dyadic blocks (level k, index i: the days from i*2^k on,
2^k of them). Blocks are what is shuffled, and equal blocks are dropped before and after the shuffle, so
however many rows an account has, what reaches one task is bounded by twice the days of the calendar
range. There, blocks covered by an ancestor go, siblings become their parent, level by level, and adjacent
blocks are coalesced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Levels of dyadic blocks: 2^22 days are more than the calendar from year 1 to 9999 has.
LEVELS = 23
#: Days are counted from here so that no count is negative.
ORIGIN = "0001-01-01"
#: Days set aside for each key when many keys are merged on one axis.
KEY_BITS = 32


def dyadic_blocks(intervals: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """(key, level, index): the canonical blocks of each interval, both bounds included; duplicates dropped."""
    origin = F.to_date(F.lit(ORIGIN))
    low = F.datediff(F.col(first), origin)
    high = F.datediff(F.col(last), origin) + 1
    up, down = "shiftright(_low + shiftleft(1L, k) - 1, k)", "shiftright(_high, k)"
    blocks = F.expr(
        f"""flatten(transform(sequence(0, {LEVELS - 1}), k -> filter(array(
            if({up} < {down} and ({up} & 1) = 1, named_struct('level', k, 'index', {up}), null),
            if({up} < {down} and ({down} & 1) = 1, named_struct('level', k, 'index', {down} - 1), null)
        ), b -> b is not null)))"""
    )
    return (
        intervals.filter(F.col(first).isNotNull() & F.col(last).isNotNull() & (F.col(first) <= F.col(last)))
        .select(F.col(key).alias("_key"), low.cast("long").alias("_low"), high.cast("long").alias("_high"))
        .distinct()
        .select("_key", F.explode(blocks).alias("_b"))
        .select(F.col("_key").alias(key), F.col("_b.level").alias("level"), F.col("_b.index").alias("index"))
        .distinct()
    )


def merge_blocks(level: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first day, day after the last) of the maximal runs that the blocks cover."""
    start, size = index.astype(np.int64) << level, np.int64(1) << level.astype(np.int64)
    order = np.lexsort((-size, start))
    level, start, size = level[order], start[order], size[order]
    reach = np.maximum.accumulate(start + size)
    kept = np.ones(len(start), bool)
    kept[1:] = start[1:] >= reach[:-1]  # dyadic blocks nest or are disjoint: else an ancestor covers it
    level, start = level[kept], start[kept]
    for k in range(int(level.min(initial=0)), LEVELS - 1):
        at = np.flatnonzero(level == k)
        if len(at) < 2:
            continue
        low = at[:-1][(np.diff(start[at]) == 1 << k) & ((start[at[:-1]] >> k) & 1 == 0)]
        high = low + 1  # its sibling lies next to it, as nothing covered is left between
        level[low] += 1
        rest = np.ones(len(start), bool)
        rest[high] = False
        level, start = level[rest], start[rest]
    end = start + (np.int64(1) << level.astype(np.int64))
    head = np.ones(len(start), bool)
    head[1:] = start[1:] > end[:-1]
    return start[head], np.concatenate([end[:-1][head[1:]], end[-1:]])


def _changes(keys: pa.Array) -> np.ndarray:
    """True where a key differs from the one before; null equals null."""
    out = np.ones(len(keys), bool)
    if len(keys) > 1:
        a, b = keys.slice(1), keys.slice(0, len(keys) - 1)
        differ = pc.fill_null(pc.not_equal(a, b), True).to_numpy(zero_copy_only=False)
        both = pc.and_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
        out[1:] = differ & ~both
    return out


def periods_and_gaps(intervals: DataFrame, key: str = "account", first: str = "period_start", last: str = "period_end") -> DataFrame:
    """(key, kind, first_day, last_day) with kind `period` for covered runs of days and `gap` between them.

    Intervals with a null or reversed bound are no intervals. Equal, nested, overlapping and adjacent ones
    join into one period. A null key is a key like any other. Extra columns are ignored; an empty table
    gives an empty table.
    """
    blocks = dyadic_blocks(intervals, key, first, last)
    schema = T.StructType([blocks.schema[key], T.StructField("kind", T.StringType()), T.StructField("_first", T.IntegerType()), T.StructField("_last", T.IntegerType())])

    def merged_rows(table: pa.Table) -> pa.RecordBatch:
        """Periods and gaps of whole keys: keys are set far apart on one axis and merged together."""
        keys = table.column(0).combine_chunks()
        level, index = (table.column(i).to_numpy().astype(np.int64) for i in (1, 2))
        place = np.cumsum(_changes(keys)) - 1
        start, end = merge_blocks(level, index + (place << (KEY_BITS - level)))
        owner = start >> KEY_BITS
        days = lambda x, o: (x - (o << KEY_BITS)).astype(np.int32)
        gap = np.flatnonzero(owner[1:] == owner[:-1])
        begin = np.concatenate([days(start, owner), days(end[gap], owner[gap])])
        stop = np.concatenate([days(end - 1, owner), days(start[gap + 1] - 1, owner[gap])])
        kinds = pa.array(["period"] * len(start) + ["gap"] * len(gap))
        heads = np.flatnonzero(_changes(keys))[np.concatenate([owner, owner[gap]])]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(heads)), kinds, pa.array(begin), pa.array(stop)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the blocks of the key that the rows so far end with; their number is bounded
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.concat_tables([*([held] if held is not None else []), pa.Table.from_batches([batch])])
            last = int(np.flatnonzero(_changes(rows.column(0).combine_chunks()))[-1])
            if last:
                yield merged_rows(rows.slice(0, last))
            held = rows.slice(last)
        if held is not None:
            yield merged_rows(held)

    def day(column: str) -> F.Column:
        return F.date_format(F.date_add(F.to_date(F.lit(ORIGIN)), F.col(column)), "yyyy-MM-dd")

    merged = blocks.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)
    return merged.select(key, "kind", day("_first").alias("first_day"), day("_last").alias("last_day"))
