"""Collapsing records whose text differs only in writing: blanks, case, punctuation, order of words.

A lookup table maps every code point to its folded form, or to 0 where it separates words. Texts stream
through it into polynomial hashes of their words, read off one running sum (the multiplier is odd, so its
powers can be divided out), and the mixed word hashes are added up, which makes the result blind to the
order of the words but not to how often each occurs. Canonical strings are never built. Rows whose hashes
collide are verified against the first row of their group with two pointers that skip separators.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.session import written

MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WRAP = 1 << 64
#: Characters hashed at once; a longer text is a run of its own.
RUN_BYTES = 8 << 20
#: Longs of the bitmap of groups that is broadcast, whatever the data: 16 bytes each in the joined table.
BITMAP_WORDS = 1 << 18


def _folded(c: str) -> int:
    if unicodedata.category(c)[0] not in "LN":
        return 0
    for form in (c.casefold(), c.lower()):
        if len(form) == 1:
            return ord(form)
    return ord(c)


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Folded code of every code point, 0 for those that are no letter or digit."""
    return np.fromiter((_folded(chr(c)) for c in range(0x110000)), np.uint32, 0x110000)


@lru_cache(maxsize=4)
def _powers(multiplier: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return run(multiplier), run(pow(multiplier, -1, _WRAP))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(codes: np.ndarray, breaks: np.ndarray, multiplier: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word in folded codes; no word goes over a position in breaks."""
    inside = codes != 0
    edge = np.zeros(len(codes) + 1, bool)
    edge[breaks] = True
    edge = edge[:-1]
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]) | inside & edge)
    following = np.concatenate([~inside[1:] | edge[1:], [True]])
    ends = np.flatnonzero(inside & following) + 1
    size = 1 << max(12, int(len(codes)).bit_length())
    power, inverse = _powers(multiplier, size)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes.astype(np.uint64) * power[: len(codes)], out=total[1:], dtype=np.uint64)
    return starts, ends, (total[ends] - total[starts]) * inverse[starts]


def _parts(text: str, limit: int) -> list[str]:
    """text cut into parts of at least limit characters, each but the last with a separator at its end."""
    fold, out, at = fold_table(), [], 0
    while len(text) - at > limit:
        stop = next((k for k in range(at + limit, len(text)) if not fold[ord(text[k])]), len(text))
        out.append(text[at:stop])
        at = stop
    return [*out, text[at:]]


def hash_texts(texts: pa.Array, limit: int = RUN_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the words of each text, blind to their order; 0 for a text without words.

    As the words' hashes are added up, the parts of a very long text are hashed one by one.
    """
    if len(texts) == 1 and texts[0].is_valid and len(texts[0].as_py()) > limit:
        sums = [hash_texts(pa.array([p])) for p in _parts(texts[0].as_py(), limit)]
        return sum(a for a, _ in sums), sum(b for _, b in sums)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = fold_table()[np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)]
    edges = np.concatenate([[0], np.cumsum(lengths)])
    out = []
    for multiplier in MULTIPLIERS:
        sums = np.zeros(len(texts), np.uint64)
        if len(codes):
            starts, ends, hashes = word_hashes(codes, edges, multiplier)
            if len(starts):
                owner = np.searchsorted(edges, starts, side="right") - 1
                head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                sums[owner[head]] = np.add.reduceat(_mix(hashes + (ends - starts).astype(np.uint64)), head)
        out.append(sums.view(np.int64))
    return out[0], out[1]


def _same_run(a: str, i: int, end_a: int, b: str, j: int, end_b: int, fold: np.ndarray) -> bool:
    if end_a - i != end_b - j:
        return False
    return all(x == y or fold[ord(x)] == fold[ord(y)] for x, y in zip(a[i:end_a], b[j:end_b]))


def _spans(text: str) -> list[tuple[int, int, int]]:
    """(length, hash, start) of the words of text."""
    codes = fold_table()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    if not len(codes):
        return []
    starts, ends, hashes = word_hashes(codes, np.zeros(0, np.int64), MULTIPLIERS[0])
    return sorted(zip((ends - starts).tolist(), hashes.tolist(), starts.tolist()))


def same_words(a: str | None, b: str | None) -> bool:
    """Whether two texts have the same words equally often. In order: two pointers that skip separators."""
    a, b = a or "", b or ""
    if a == b:
        return True
    fold = fold_table()
    i = j = 0
    while True:
        while i < len(a) and not fold[ord(a[i])]:
            i += 1
        while j < len(b) and not fold[ord(b[j])]:
            j += 1
        if i == len(a) or j == len(b):
            if i == len(a) and j == len(b):
                return True
            break
        k, m = i, j
        while k < len(a) and m < len(b) and (x := fold[ord(a[k])]) and x == fold[ord(b[m])]:
            k, m = k + 1, m + 1
        if (k < len(a) and fold[ord(a[k])]) or (m < len(b) and fold[ord(b[m])]):
            break
        i, j = k, m
    first, second = _spans(a), _spans(b)
    return len(first) == len(second) and all(_same_run(a, p, p + n, b, q, q + m, fold) for (n, _, p), (m, _, q) in zip(first, second))


def canonical(text: str | None) -> str:
    """The sorted folded words, only for rows whose hashes collided without being the same."""
    fold = fold_table()
    return " ".join(sorted("".join(chr(fold[ord(c)] or 32) for c in text or "").split()))


def _hashed(rows: DataFrame, text_col: str) -> DataFrame:
    """rows with _h1 and _h2, the hashes of text_col."""
    schema = T.StructType([*rows.schema.fields, T.StructField("_h1", T.LongType()), T.StructField("_h2", T.LongType())])
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
            run = np.cumsum(sizes) // RUN_BYTES
            heads = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else run
            # A text that fills a run by itself is taken alone.
            cuts = np.unique(np.concatenate([heads, heads + 1, [batch.num_rows]]))
            for k, stop in zip(cuts.tolist(), cuts.tolist()[1:]):
                part = batch.slice(k, stop - k)
                h1, h2 = hash_texts(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(h1), pa.array(h2)], names=schema.names)

    return rows.mapInArrow(run, schema)


def with_listed_marks(rows: DataFrame, marks: DataFrame, words: int = BITMAP_WORDS) -> DataFrame:
    """The rows whose _a may be among those of marks: a bitmap of fixed size, broadcast, lets few others pass.

    The bitmap is a table of at most `words` longs, put together with partial aggregates; where marks are so many
    that it fills up it only lets more through. Rows that pass wrongly go in the join that follows.
    """
    spot = F.pmod(F.col("_a"), words)
    bit = F.shiftright(F.col("_a"), 58).bitwiseAND(63).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bitmap = marks.groupBy(spot.alias("_word")).agg(F.bit_or(one).alias("_bits"))
    met = rows.withColumn("_word", spot).join(F.broadcast(bitmap), "_word")
    return met.filter(F.col("_bits").bitwiseAND(one) != 0).drop("_word", "_bits")


def collapse(rows: DataFrame, id_col: str = "ord", text_col: str = "description", keys: tuple[str, ...] = ("account", "amount", "date")) -> DataFrame:
    """(first, copy) ids: each row that repeats another one, with the smallest id of its group.

    Rows form a group if they agree in keys (null equals null) and have the same words equally often. A
    null, empty or wordless text has no words; such texts are equal. Ids should be unique; rows that repeat
    an id wholly count as one. Extra columns are ignored, an empty table gives no rows, texts are read whole
    at any length.

    Texts are hashed once. What is grouped is two longs for each row, with partial aggregates, so a group that
    holds a third of all rows is never gathered in a task. Only rows of groups of several are moved with their
    texts, after a bitmap of those groups; AQE splits the partitions of hot groups in the two joins.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    slim = rows.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *(F.col(k).alias(n) for k, n in zip(keys, names)))
    hashed = _hashed(slim, "_text").withColumn("_a", F.xxhash64("_h1", "_h2", *names)).drop("_h1", "_h2")
    keyed = written(hashed, "hashed")
    groups = keyed.groupBy("_a").agg(F.min("_id").alias("_to"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    groups = written(groups, "groups")
    several = written(with_listed_marks(keyed, groups).join(groups, "_a"), "copies")
    firsts = several.filter("_id = _to").select("_a", F.col("_text").alias("_other"), *(F.col(n).alias(f"_first{n}") for n in names)).distinct()
    same_keys = F.lit(True)
    for n in names:
        same_keys = same_keys & F.col(n).eqNullSafe(F.col(f"_first{n}"))
    pairs = several.filter("_id <> _to").join(firsts, "_a").select("_id", "_text", *names, "_to", "_other", same_keys.alias("_same"))
    schema = T.StructType(
        [
            T.StructField("_to", pairs.schema["_to"].dataType),
            T.StructField("_id", pairs.schema["_id"].dataType),
            *(T.StructField(n, pairs.schema[n].dataType) for n in names),
            T.StructField("_ok", T.BooleanType()),
            T.StructField("_words", T.StringType()),
        ]
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, other, same = (batch.column(c).to_pylist() for c in ("_text", "_other", "_same"))
            ok = [s and same_words(a, b) for a, b, s in zip(text, other, same)]
            words = [None if fine else canonical(a) for a, fine in zip(text, ok)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_to"), batch.column("_id"), *(batch.column(n) for n in names), pa.array(ok, pa.bool_()), pa.array(words, pa.string())], names=schema.names
            )

    verified = written(pairs.mapInArrow(verify, schema), "collapse")
    kept = verified.filter("_ok").select("_to", "_id")
    # Rows whose hashes collided by chance are grouped by their words themselves.
    rest = verified.filter("not _ok")
    heads = rest.groupBy(*names, "_words").agg(F.min("_id").alias("_head"))
    same = F.col("r._words") == F.col("h._words")
    for n in names:
        same = same & F.col(f"r.{n}").eqNullSafe(F.col(f"h.{n}"))
    exact = rest.alias("r").join(heads.alias("h"), same).filter("r._id <> _head").select(F.col("_head").alias("_to"), "r._id")
    return kept.unionByName(exact)


def with_copies(rows: DataFrame, collapsed: DataFrame, id_col: str = "ord") -> DataFrame:
    """One record for each group, with copies, the number of rows it stands for.

    collapsed: what collapse() gave for rows. One join: the heads of groups with their number, the rest with 0.
    """
    heads = collapsed.groupBy(F.col("_to").alias("_at")).agg((F.count("*") + 1).alias("copies"))
    marks = heads.unionByName(collapsed.select(F.col("_id").alias("_at"), F.lit(0).cast("long").alias("copies")))
    counted = rows.join(marks, rows[id_col] == F.col("_at"), "left").drop("_at").withColumn("copies", F.coalesce("copies", F.lit(1).cast("long")))
    return counted.filter("copies > 0")
