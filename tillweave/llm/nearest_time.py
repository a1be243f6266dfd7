"""Pairing records of two tables by the nearest time within a tolerance, for the same entity.

Times are cut into buckets by their high bits, and the key of the shuffle is entity and bucket, so one
entity that holds a third of all rows is spread over all its buckets; buckets that are still too full are cut at
quantiles of their times. Candidates are copied to the buckets their tolerance reaches. Each task streams its rows in order and, for every batch, hashes all bit-prefixes
of the candidates' times into x-fast trie tables; a query finds its longest present prefix by binary
search over the prefix length, which gives predecessor and successor at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.functions.columns import wall_micros
from tillweave.session import written

HOURS_48 = 48 * 3600 * 1_000_000
#: Rows of one trie. With at most 2^16 entities, 6 bits of level and 41 bits of time a prefix is one integer.
TRIE_ROWS = 1 << 15
#: Rows of one entity and bucket that one task takes; more are split by time, and queries of one moment dealt out.
SPLIT_ROWS = 1_000_000
#: Parts that such a bucket is split into, at quantiles of its times.
TIME_PARTS = 256


class XFastTrie:
    """Prefix tables of many entities' sorted, distinct times; all queries are answered together."""

    def __init__(self, entity: np.ndarray, time: np.ndarray, width: int) -> None:
        self.entity, self.time, self.width = entity.astype(np.int64), time.astype(np.int64), width
        keys, low, high = [], [], []
        for level in range(width + 1):
            prefix = self._key(self.entity, level, self.time >> (width - level))
            head = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]])) if len(prefix) else np.zeros(0, np.int64)
            keys.append(prefix[head])
            low.append(head)
            high.append(np.concatenate([head[1:], [len(prefix)]]) - 1 if len(head) else head)
        self.low, self.high = np.concatenate(low), np.concatenate(high)
        self.table = dict(zip(np.concatenate(keys).tolist(), range(len(self.low))))

    def _key(self, entity: np.ndarray, level: np.ndarray | int, prefix: np.ndarray) -> np.ndarray:
        return (entity << 47) | (np.asarray(level, np.int64) << 41) | prefix

    def _find(self, entity: np.ndarray, level: np.ndarray, time: np.ndarray) -> np.ndarray:
        keys = self._key(entity, level, time >> (self.width - level))
        return np.fromiter(map(self.table.get, keys.tolist(), repeat(-1)), np.int64, len(keys))

    def neighbours(self, entity: np.ndarray, time: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the last time not after, and the first not before; -1 where there is none."""
        n = len(time)
        low, high = np.zeros(n, np.int64), np.full(n, self.width, np.int64)
        node = self._find(entity, low, time)
        known = node >= 0
        while (open_ := low < high).any():
            mid = (low + high + 1) >> 1
            at = self._find(entity, mid, time)
            hit = open_ & (at >= 0)
            node = np.where(hit, at, node)
            low = np.where(hit, mid, low)
            high = np.where(open_ & ~hit, mid - 1, high)
        first, last = self.low[node], self.high[node]
        exact = low == self.width
        goes_right = ((time >> np.maximum(self.width - low - 1, 0)) & 1) == 1
        before = np.where(exact | goes_right, last, first - 1)
        after = np.where(exact, first, np.where(goes_right, last + 1, first))
        size = len(self.entity)
        before = np.where(known & (before >= 0) & (self.entity[np.clip(before, 0, size - 1)] == entity), before, -1) if size else np.full(n, -1)
        after = np.where(known & (after < size) & (self.entity[np.clip(after, 0, size - 1)] == entity), after, -1) if size else np.full(n, -1)
        return before, after


def _choose(time: np.ndarray, t1: np.ndarray, id1: np.ndarray, t2: np.ndarray, id2: np.ndarray, tolerance: int) -> tuple[np.ndarray, np.ndarray]:
    """(found, id): the nearer of two candidates, the smaller id of equally near ones; an id below 0 is none."""
    far = np.int64(1) << 62
    d1 = np.where(id1 >= 0, np.abs(time - t1), far)
    d2 = np.where(id2 >= 0, np.abs(t2 - time), far)
    second = (d2 < d1) | ((d2 == d1) & (id2 < id1))
    return np.minimum(d1, d2) <= tolerance, np.where(second, id2, id1)


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds of a time since 1970; for a time without a zone whatever the zone of the session."""
    t = F.col(name)
    if not isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.unix_micros(t.cast("timestamp"))
    return wall_micros(t)


def _split_hot(entries: DataFrame, legs: DataFrame, bucket: list[str], split_rows: int) -> tuple[DataFrame, DataFrame]:
    """entries and legs with _part and _salt, so that no entity and bucket with very many of either is one group.

    Such a bucket is cut at quantiles of its times. A part gets, besides its own entries, the last one before it and
    the first one behind it, which are all that a query in it can need from others. Only queries crowded into
    one moment still make a large part; they are dealt out, and the few entries of the part copied to each deal.
    """
    both = entries.select(*bucket, "_t").unionByName(legs.select(*bucket, "_t"))
    hot = both.groupBy(*bucket).agg(F.count("*").alias("_n")).filter(F.col("_n") > split_rows).select(*bucket)
    if hot.isEmpty():
        return tuple(df.withColumns({"_part": F.lit(0), "_salt": F.lit(0)}) for df in (entries, legs))
    quantiles = [k / TIME_PARTS for k in range(1, TIME_PARTS)]
    cuts = both.join(written(hot, "hot-entities"), bucket, "left_semi").groupBy(*bucket).agg(F.array_distinct(F.percentile_approx("_t", quantiles, 1000)).alias("_cuts"))
    cuts = written(cuts, "time-cuts")
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("_t"))), F.lit(0))
    entries, legs = (df.join(cuts, bucket, "left").withColumn("_part", F.when(F.col("_cuts").isNull(), 0).otherwise(part)).drop("_cuts") for df in (entries, legs))
    edges = entries.join(cuts.select(*bucket), bucket, "left_semi").groupBy(*bucket, "_part").agg(F.min("_t").alias("_t0"), F.min_by("_id", "_t").alias("_id0"), F.max("_t").alias("_t1"), F.max_by("_id", "_t").alias("_id1"))
    parts = cuts.select(*bucket, F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias("_part")).join(edges, [*bucket, "_part"], "left")
    by_part = Window.partitionBy(*bucket).orderBy("_part")
    before, behind = by_part.rowsBetween(Window.unboundedPreceding, -1), by_part.rowsBetween(1, Window.unboundedFollowing)
    nearest = F.array(*(F.struct(pick(t, ignorenulls=True).over(w).alias("_t"), pick(i, ignorenulls=True).over(w).alias("_id")) for pick, t, i, w in ((F.last, "_t1", "_id1", before), (F.first, "_t0", "_id0", behind))))
    borders = parts.withColumn("_near", nearest).select(*bucket, "_part", F.inline("_near")).filter("_id is not null").withColumn("_side", F.lit(0).cast("byte"))
    entries = entries.unionByName(borders.select(entries.columns))
    crowded = written(legs.groupBy(*bucket, "_part").agg(F.ceil(F.count("*") / split_rows).cast("int").alias("_salts")).filter("_salts > 1"), "crowded")
    dealt = F.coalesce("_salts", F.lit(1))
    legs = legs.join(crowded, [*bucket, "_part"], "left").withColumn("_salt", F.pmod(F.xxhash64("_id"), dealt).cast("int"))
    entries = entries.join(crowded, [*bucket, "_part"], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), dealt - 1)))
    return entries, legs


def match_nearest(
    left: DataFrame, right: DataFrame, keys: tuple[str, ...], left_id: str, left_time: str, right_id: str, right_time: str, tolerance_us: int, trie_rows: int = TRIE_ROWS, split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """(left_id, right_id): for each row of left the row of right that agrees in keys and is nearest in time.

    Before or after, at most tolerance_us microseconds away; of equally near rows the smallest id, which must
    be a bigint not below 0. Each row of left is judged alone, so a row of right may serve several. Rows with
    a null key, time or id match nothing. Rows of left that are repeated wholly stay repeated; extra columns
    are ignored, an empty table on either side gives no rows.
    """
    bits = max(20, int(2 * tolerance_us).bit_length())
    if bits > 39:
        raise ValueError("the tolerance must be below 2^38 microseconds")
    width = bits + 2
    names = [f"_k{i}" for i in range(len(keys))]

    def slim(df: DataFrame, id_col: str, time_col: str, side: int) -> DataFrame:
        at = micros(df, time_col)
        out = df.select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(id_col).cast("long").alias("_id"), at.alias("_t"), F.lit(side).cast("byte").alias("_side"))
        return out.dropna(subset=[*names, "_id", "_t"])

    entries = slim(right, right_id, right_time, 0)
    entries = entries.groupBy(*names, "_t").agg(F.min("_id").alias("_id")).withColumn("_side", F.lit(0).cast("byte"))
    reach = F.sequence(F.shiftright(F.col("_t") - tolerance_us, bits), F.shiftright(F.col("_t") + tolerance_us, bits))
    entries = entries.withColumn("_bucket", F.explode(reach))
    legs = slim(left, left_id, left_time, 1).withColumn("_bucket", F.shiftright("_t", bits))
    group = [*names, "_bucket", "_part", "_salt"]
    order = [*group, "_t", "_side", "_id"]
    entries, legs = _split_hot(entries, legs, [*names, "_bucket"], split_rows)
    rows = entries.select(order).unionByName(legs.select(order)).repartition(*group).sortWithinPartitions(*order)
    schema = T.StructType([T.StructField("left_id", T.LongType()), T.StructField("right_id", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key = None  # the entity that the rows before ended with, its last candidate and its open queries
        held_entry: tuple[int, int] | None = None
        pending: list[tuple[np.ndarray, ...]] = []

        def settle(succ_t: int, succ_id: int) -> Iterator[pa.RecordBatch]:
            for ids, times, before_t, before_id in pending:
                n = len(ids)
                found, chosen = _choose(times, before_t, before_id, np.full(n, succ_t), np.full(n, succ_id), tolerance_us)
                if found.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(chosen[found])], names=schema.names)
            pending.clear()

        for whole in batches:
            for at in range(0, whole.num_rows, trie_rows):
                batch = whole.slice(at, trie_rows)
                n = batch.num_rows
                change = np.zeros(n, bool)
                change[0] = True
                for name in group:
                    c = batch.column(name)
                    if n > 1:
                        change[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                entity = np.cumsum(change) - 1
                t, ids, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_t", "_id", "_side"))
                bucket = batch.column("_bucket").to_numpy(zero_copy_only=False)
                rel = t - (bucket << bits) + (np.int64(1) << bits)
                key = tuple(batch.column(g)[0].as_py() for g in group)
                if key != held_key:
                    yield from settle(0, -1)
                    held_entry = None
                is_entry = side == 0
                e_ent, e_rel, e_id = entity[is_entry], rel[is_entry], ids[is_entry]
                if pending and len(e_ent) and e_ent[0] == 0:
                    yield from settle(int(t[is_entry][0]), int(e_id[0]))
                last = entity[-1]
                if last != 0:  # what is still open belongs to the entity that ends in this batch
                    yield from settle(0, -1)
                if held_entry is not None:
                    e_ent = np.concatenate([[0], e_ent])
                    e_rel = np.concatenate([[held_entry[0] - (int(bucket[0]) << bits) + (1 << bits)], e_rel])
                    e_id = np.concatenate([[held_entry[1]], e_id])
                q = ~is_entry
                q_ent, q_rel, q_id, q_t = entity[q], rel[q], ids[q], t[q]
                if len(q_ent):
                    if len(e_ent):
                        before, after = XFastTrie(e_ent, e_rel, width).neighbours(q_ent, q_rel)
                        b_t, b_id = e_rel[before], np.where(before >= 0, e_id[before], -1)
                        a_t, a_id = e_rel[after], np.where(after >= 0, e_id[after], -1)
                    else:
                        b_t = a_t = np.zeros(len(q_ent), np.int64)
                        b_id = a_id = np.full(len(q_ent), -1, np.int64)
                    open_ = (q_ent == last) & (a_id < 0)
                    found, chosen = _choose(q_rel, b_t, b_id, a_t, a_id, tolerance_us)
                    found &= ~open_
                    if found.any():
                        yield pa.RecordBatch.from_arrays([pa.array(q_id[found]), pa.array(chosen[found])], names=schema.names)
                    if open_.any():
                        pending.append((q_id[open_], q_t[open_], b_t[open_] + (q_t[open_] - q_rel[open_]), b_id[open_]))
                mine = np.flatnonzero(e_ent == last)
                if len(mine):
                    held_entry = (int(e_rel[mine[-1]]) + (int(bucket[-1]) << bits) - (1 << bits), int(e_id[mine[-1]]))
                elif last != 0:
                    held_entry = None
                held_key = tuple(batch.column(g)[n - 1].as_py() for g in group)
        yield from settle(0, -1)

    return rows.mapInArrow(run, schema)
