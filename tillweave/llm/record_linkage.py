"""Checking new batches against everything accepted before, without working through all of it again.

Accepted records are persisted in a blocking-key table, bucketed by the hash of account, amount and date and
partitioned by year. A batch probes it with the keys of its own days and the two days around: only the batch
moves, each bucket is read where it lies, and only history with a probed key goes further. Records equal but for
writing and order are taken together as classes, classes of one block are compared field by field, and the
comparison levels are weighed with weights that expectation maximisation learns from the counts of all pairs of
the first batch, those never compared one by one included; they are kept beside the table, so that a row's answer
doesn't depend on later batches.
Links append parents to a union-find forest, for the roots and the new records they touch and for no others.

Words count as the same if they are equal, misspelt or cut off, and misspelt words must share a key: of their
first four letters or of their last four, one at most may differ. So a block of many classes
need not be compared pair by pair: its classes meet in sub-blocks of word key and number key, each class asking
only with its rarest words. As at least TEXT_LEVELS[0] of one side's letters must be accounted for, words that hold
more than the rest of its letters can't all be without a partner, so nothing is lost by that. The pairs that don't
meet are counted without being listed: what texts of equal words share is compared once, what texts of equal numbers
share likewise, and the pairs in all follow from the sizes of the blocks (large_counts).
"""

from __future__ import annotations

import json
import math
import re
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillweave.session import shared_dir, written

RECORD = ("id", "account", "amount", "date", "text")
DAYS = 2
#: Buckets of the blocking-key table, a parameter of the index: so many that one fits a task.
BUCKETS = 16
#: Classes of one account, amount and day up to which a block is compared pair by pair. The links are the same.
BLOCK_CLASSES = 64
#: Pairs of words of two descriptions up to which each is tried; of more, those that share a key are looked up.
MANY_PAIRS = 2_000

_WORD = re.compile(r"[^\W_]+")
TEXT_LEVELS = (0.6, 0.72, 0.84, 0.94)
EQUAL, CUT, ONE_SIDE, CONFLICT, NONE = range(5)
#: What expectation maximisation starts from, worth PRIOR_PAIRS pairs: P(level | match) and P(level | no match).
PRIOR_MATCH = ((0.002, 0.008, 0.05, 0.24, 0.70), (0.58, 0.10, 0.25, 0.001, 0.069), (0.6, 0.2, 0.2))
PRIOR_OTHER = ((0.86, 0.10, 0.025, 0.01, 0.005), (0.01, 0.01, 0.28, 0.5, 0.2), (0.4, 0.35, 0.25))
PRIOR_PAIRS = 200.0


def distance(a: str, b: str, most: int) -> int:
    """Edits, swaps of neighbours included, between two words; most + 1 where there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return row[-1]


def _split(text: str | None) -> tuple[list[str], list[str]]:
    words = _WORD.findall((text or "").lower())
    return [w for w in words if not w.isdigit()], [w for w in words if w.isdigit()]


def _without_one(letters: str) -> Iterator[str]:
    return (letters[:i] + letters[i + 1 :] for i in range(len(letters)))


@lru_cache(maxsize=100_000)
def asking_keys(word: str) -> frozenset[str]:
    """Keys a word asks with: its first four letters without one of them, its last four likewise."""
    keys = {"^" + k for k in _without_one(word[:4])} | {"$" + k for k in _without_one(word[-4:])}
    return frozenset(keys | {"^" + word} if len(word) < 4 else keys)


@lru_cache(maxsize=100_000)
def listed_keys(word: str) -> frozenset[str]:
    """Keys a word is found by: those it asks with, and short beginnings for words cut off early."""
    return asking_keys(word) | {"^" + word[:k] for k in (1, 2, 3)}


def _keyed(a: str, b: str) -> bool:
    return not asking_keys(a).isdisjoint(listed_keys(b)) or not asking_keys(b).isdisjoint(listed_keys(a))


class _Partners:
    """The words of one side that may be partners of a word: all of few, of many those that share a key with it."""

    def __init__(self, words: list[str], asked: int) -> None:
        self.words = words
        self.many = asked * len(words) > MANY_PAIRS
        self.by_key: dict[bool, dict[str, list[int]]] = {True: {}, False: {}}
        if self.many:
            for j, v in enumerate(words):
                for asking, keys in ((True, asking_keys(v)), (False, listed_keys(v))):
                    for k in keys:
                        self.by_key[asking].setdefault(k, []).append(j)

    def of(self, word: str) -> Iterator[int]:
        """Places of the words that share a key with word, in order."""
        if not self.many:
            return (j for j, v in enumerate(self.words) if _keyed(word, v))
        met = [self.by_key[False].get(k, ()) for k in asking_keys(word)] + [self.by_key[True].get(k, ()) for k in listed_keys(word)]
        return iter(sorted(set().union(*met)))


def _coverage(a: list[str], b: list[str]) -> float:
    """Share of the letters of a's words that words of b account for, each once: equal, misspelt or cut off."""
    total = sum(map(len, a))
    if not total:
        return 1.0
    counts = Counter(b)
    open_ = []
    score = 0.0
    for w in a:
        if counts[w] > 0:
            counts[w] -= 1
            score += len(w)
        else:
            open_.append(w)
    rest = list(counts.elements())
    if open_ and rest:
        partners = _Partners(rest, len(open_))
        near = []
        for i, w in enumerate(open_):
            for j in partners.of(w):
                size = max(len(w), len(rest[j]))
                most = max(1, size // 3)
                d = distance(w, rest[j], most)
                if d <= most:
                    near.append((d / size, i, j))
        used: set[int] = set()
        taken: set[int] = set()
        for share, i, j in sorted(near):
            if i not in used and j not in taken:
                used.add(i)
                taken.add(j)
                score += len(open_[i]) * (1 - 0.5 * share)
        open_ = [w for i, w in enumerate(open_) if i not in used]
        rest = [v for j, v in enumerate(rest) if j not in taken]
    return (score + _cut_off(open_, rest)) / total


def _cut_off(open_: list[str], rest: list[str]) -> float:
    """Letters of the first word of open_ that is the beginning of a word of rest, perhaps misspelt: one word may be cut off."""
    if not open_ or not rest:
        return 0.0
    ordered = sorted(rest)
    partners = _Partners(rest, len(open_))
    for w in open_:
        k = bisect_left(ordered, w)
        if k < len(ordered) and ordered[k].startswith(w):
            return float(len(w))
        if len(w) > 3:
            most = len(w) // 3
            if any(len(rest[j]) > len(w) and distance(w, rest[j][: len(w)], most) <= most for j in partners.of(w)):
                return 0.8 * len(w)
    return 0.0


def compare_numbers(a: list[str], b: list[str]) -> int:
    if not a and not b:
        return NONE
    if not a or not b:
        return ONE_SIDE
    few, many = (a, list(b)) if len(a) <= len(b) else (b, list(a))
    cut = False
    for n in few:
        if n in many:
            many.remove(n)
            continue
        v = None if cut else next((m for m in many if m.startswith(n) or n.startswith(m)), None)
        if v is None:
            return CONFLICT
        many.remove(v)
        cut = True
    return CUT if cut else EQUAL


def compare_text(a: str | None, b: str | None) -> tuple[int, int]:
    """(level of the words, relation of the numbers) of two descriptions."""
    (wa, na), (wb, nb) = _split(a), _split(b)
    if not (wa or na) or not (wb or nb):
        return (len(TEXT_LEVELS), NONE) if not (wa or na or wb or nb) else (0, ONE_SIDE)
    if not wa or not wb:
        share = 0.0 if wa or wb else 1.0
    else:
        first, second = _coverage(wa, wb), _coverage(wb, wa)
        share = max(first, second) if min(sum(map(len, wa)), sum(map(len, wb))) > 3 else min(first, second)
    return sum(share >= t for t in TEXT_LEVELS), compare_numbers(na, nb)


def _number_keys(numbers: list[str], asking: bool) -> set[str]:
    """Keys that texts with fitting numbers share: equal ones, one cut off from the other, or none on one side.

    Of two numbers of which one begins the other, the beginnings as long as the largest power of two within the
    shorter one are equal, and for the shorter one that is its own longest such beginning.
    """
    if not numbers:
        return {"all"} if asking else {"all", "none"}
    tops, every = set(), set()
    for n in numbers:
        sizes = [1 << k for k in range(len(n).bit_length())]
        every |= {n[:k] for k in sizes}
        tops.add(n[: sizes[-1]])
    wide, narrow = {"w" + n for n in every}, {"t" + n for n in every}
    own_wide, own_narrow = {"w" + n for n in tops}, {"t" + n for n in tops}
    return own_narrow | wide | {"none"} if asking else narrow | own_wide | {"all"}


def sub_keys(text: str, rarest: list[str], asking: bool) -> set[str]:
    """Sub-blocks of a class. rarest: its words, those fewest classes of the block have first."""
    words, numbers = _split(text)
    if words:
        chosen = words
        if asking:
            left, chosen, letters = sum(map(len, words)) * (1 - TEXT_LEVELS[0]), [], Counter(words)
            for w in rarest:
                if w in letters:
                    if left < 0:
                        break
                    left -= len(w) * letters[w]
                    chosen.append(w)
        keys = set().union(*((asking_keys if asking else listed_keys)(w) for w in chosen))
    else:
        keys = {""}
    return {f"{k}|{n}" for k in keys for n in _number_keys(numbers, asking)}


@dataclass(frozen=True)
class Weights:
    """log2 likelihood ratios of the levels of words, numbers and days, and of a match before any is known."""

    fields: tuple[tuple[float, ...], ...]
    start: float

    def total(self, *levels: F.Column) -> F.Column:
        out = F.lit(self.start)
        for column, ratios in zip(levels, self.fields):
            out = out + F.element_at(F.array(*map(F.lit, ratios)), column + 1)
        return out


def learn_weights(counts: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> Weights:
    """Expectation maximisation over (levels, number of pairs) of all compared pairs, held by the priors."""
    match, other, share = [list(p) for p in PRIOR_MATCH], [list(p) for p in PRIOR_OTHER], 0.5
    total = sum(n for _, n in counts)
    for _ in range(rounds if total else 0):
        new_match = [[PRIOR_PAIRS * p for p in f] for f in PRIOR_MATCH]
        new_other = [[PRIOR_PAIRS * p for p in f] for f in PRIOR_OTHER]
        matches = 0.0
        for levels, n in counts:
            m = share * math.prod(f[x] for f, x in zip(match, levels))
            u = (1 - share) * math.prod(f[x] for f, x in zip(other, levels))
            p = m / (m + u)
            matches += n * p
            for f, x in enumerate(levels):
                new_match[f][x] += n * p
                new_other[f][x] += n * (1 - p)
        match = [[x / sum(f) for x in f] for f in new_match]
        other = [[x / sum(f) for x in f] for f in new_other]
        share = min(0.95, max(0.05, (matches + PRIOR_PAIRS / 2) / (total + PRIOR_PAIRS)))
    ratios = tuple(tuple(math.log2(a / b) for a, b in zip(m, u)) for m, u in zip(match, other))
    return Weights(ratios, math.log2(share / (1 - share)))


def records(df: DataFrame, id_col: str, text_col: str = "description") -> DataFrame:
    """The five fields the linkage uses; rows without id, account, amount or date match nothing and go."""
    return df.select(
        F.col(id_col).cast("long").alias("id"), F.col("account").cast("string").alias("account"), F.col("amount").cast("decimal(18,2)").alias("amount"), F.col("date").cast("date").alias("date"), F.col(text_col).cast("string").alias("text")
    ).dropna(subset=["id", "account", "amount", "date"])


def _key(day: F.Column) -> F.Column:
    return F.xxhash64("account", "amount", day)


def _near_days() -> F.Column:
    return F.explode(F.sequence(F.date_sub("date", DAYS), F.date_add("date", DAYS)))


def _words() -> F.Column:
    """The words of a text in one order: what records of a class have in common."""
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.array_join(F.array_sort(found), " ")


_BLOCK = ("account", "amount", "date")
_KEYED = T.StructType([T.StructField("rep", T.LongType()), T.StructField("asks", T.BooleanType()), T.StructField("k", T.StringType())])
Levels = tuple[int, int, int]


def _compared(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, text_a, text_b, more) with the levels of their words and numbers in place of the texts."""
    schema = T.StructType([*pairs.schema.fields[:2], *(T.StructField(n, T.IntegerType()) for n in ("words", "numbers")), *pairs.schema.fields[4:]])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            levels = [compare_text(x, y) for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            words, numbers = (pa.array([level[k] for level in levels], pa.int32()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*part.columns[:2], words, numbers, *part.columns[4:]], names=schema.names)

    return pairs.mapInArrow(compare, schema)


def _all_pairs(new: DataFrame, old: DataFrame) -> DataFrame:
    """Pairs of classes of one account and amount whose days are near, by an equi-join on the day."""
    new = new.select(F.col("rep").alias("a"), F.col("text").alias("text_a"), F.col("date").alias("date_a"), "account", "amount", _near_days().alias("date"))
    old = old.select(F.col("rep").alias("b"), F.col("text").alias("text_b"), *_BLOCK)
    return new.join(old, list(_BLOCK)).filter("a <> b").select("a", "b", "text_a", "text_b", F.abs(F.datediff("date", "date_a")).alias("days"), F.lit(True).alias("small"))


def _meeting(classes: DataFrame, keys_of: Callable[[str, list[str], bool], set[str]]) -> DataFrame:
    """Pairs of new classes a with listed ones b, themselves too, of near days that share a key: all columns of both."""
    words = classes.select("rep", "account", "amount", F.explode(F.array_distinct(F.split("text", " "))).alias("w"))
    counts = words.groupBy("account", "amount", "w").agg(F.count("*").alias("n"))
    order = words.join(counts, ["account", "amount", "w"]).groupBy("rep").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "w"))), lambda x: x.w).alias("rarest"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out: tuple[list, list, list] = ([], [], [])
            for rep, text, rarest in zip(*(part.column(c).to_pylist() for c in ("rep", "text", "rarest"))):
                for asks in (True, False):
                    for k in keys_of(text, rarest, asks):
                        for column, value in zip(out, (rep, asks, k)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(out, (pa.int64(), pa.bool_(), pa.string()))], names=_KEYED.names)

    own = classes.select("rep", *_BLOCK, "_new", "_listed")
    keyed = written(classes.join(order, "rep").select("rep", "text", "rarest").mapInArrow(keys, _KEYED).join(own, "rep"), "sub-blocks")
    met = lambda day: F.xxhash64("account", "amount", day, "k").alias("_h")
    new = keyed.filter("_new").withColumn("day", _near_days()).select(F.col("rep").alias("a"), "asks", met(F.col("day")))
    listed = keyed.filter("_listed").select(F.col("rep").alias("b"), (~F.col("asks")).alias("asks"), met(F.col("date")))
    pairs = new.join(listed, ["_h", "asks"]).select("a", "b").distinct()
    side = lambda x: classes.select(F.col("rep").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in classes.columns if c != "rep"))
    days = F.abs(F.datediff("date_b", "date_a"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("days", days)
    return full.filter((F.col("account_a") == F.col("account_b")) & (F.col("amount_a") == F.col("amount_b")) & (F.col("days") <= DAYS))


def _sub_block_pairs(classes: DataFrame) -> DataFrame:
    """The pairs of _all_pairs of new classes with listed ones that can be linked, by way of the sub-blocks they share."""
    return _meeting(classes, sub_keys).filter("a <> b").select("a", "b", "text_a", "text_b", "days", F.lit(False).alias("small"))


def words_alone(text: str) -> str:
    """A text with the words of text whose words compare as those of text do."""
    words, numbers = _split(text)
    return " ".join(words) or ("0" if numbers else "")


def numbers_alone(text: str) -> str:
    """A text with the numbers of text whose numbers compare as those of text do."""
    words, numbers = _split(text)
    return " ".join(numbers) or ("x" if words else "")


def large_counts(classes: DataFrame, compared: DataFrame) -> dict[Levels, int]:
    """How many pairs of new classes with listed ones have each (words, numbers, days), of all pairs, compared or not.

    compared: those of _sub_block_pairs, which hold all pairs that can be linked. Texts of equal words have the same
    words level with any other, so words that share a key are compared once for each day, with the numbers of
    classes that have them: the pairs of a words level above 0, whatever their numbers. Numbers go likewise: the
    pairs without a conflict, whatever their words. What is left of all near pairs has neither.
    """
    schema = T.StructType([*classes.schema.fields, *(T.StructField(n, T.StringType()) for n in ("_w", "_n"))])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts = part.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([f(t) for t in texts], pa.string()) for f in (words_alone, numbers_alone))], names=schema.names)

    sides = written(classes.mapInArrow(split, schema), "sides")
    sizes = [F.count_if(c).alias(n) for c, n in ((F.col("_new"), "news"), (F.col("_listed"), "listeds"), (F.col("_new") & F.col("_listed"), "both"))]

    def marginal(side: str, level: str, keys_of: Callable[[str, list[str], bool], set[str]]) -> dict[tuple[int, int], int]:
        groups = sides.groupBy(*_BLOCK, F.col(side).alias("text")).agg(F.min("rep").alias("rep"), *sizes)
        groups = written(groups.withColumn("_new", F.col("news") > 0).withColumn("_listed", F.col("listeds") > 0), "groups")
        # A class makes no pair with itself.
        n = F.col("news_a") * F.col("listeds_b") - F.when(F.col("a") == F.col("b"), F.col("both_a")).otherwise(0)
        pairs = _compared(_meeting(groups, keys_of).select("a", "b", "text_a", "text_b", "days", n.alias("n")))
        return {(r[0], r[1]): r[2] for r in pairs.groupBy(level, "days").agg(F.sum("n")).collect()}

    by_words = marginal("_w", "words", sub_keys)
    by_numbers = marginal("_n", "numbers", lambda text, _, asking: _number_keys(_split(text)[1], asking))
    days = sides.groupBy(*_BLOCK).agg(*sizes)
    new = days.filter("news > 0").select("account", "amount", "news", F.col("date").alias("date_a"), _near_days().alias("date"))
    near = new.join(days.drop("news"), list(_BLOCK)).withColumn("days", F.abs(F.datediff("date", "date_a")))
    n = F.col("news") * F.col("listeds") - F.when(F.col("days") == 0, F.col("both")).otherwise(0)
    every = {r[0]: r[1] for r in near.groupBy("days").agg(F.sum(n)).collect()}

    linkable = compared.filter((F.col("words") > 0) & (F.col("numbers") != CONFLICT)).groupBy("words", "numbers", "days").count()
    out = {(r[0], r[1], r[2]): r[3] for r in linkable.collect()}
    some, fitting = range(1, len(TEXT_LEVELS) + 1), [r for r in range(NONE + 1) if r != CONFLICT]
    for d, total in every.items():
        for w in some:
            out[w, CONFLICT, d] = by_words.get((w, d), 0) - sum(out.get((w, r, d), 0) for r in fitting)
        for r in fitting:
            out[0, r, d] = by_numbers.get((r, d), 0) - sum(out.get((w, r, d), 0) for w in some)
        out[0, CONFLICT, d] = total - sum(n for (_, _, day), n in out.items() if day == d)
    return {levels: n for levels, n in out.items() if n}


class LinkageIndex:
    """Persisted blocking-key table of accepted records, their weights, and the forest of their clusters.

    Ids must be unique over history and batches, and those of a batch larger than all before. All parts live
    under path, in a folder all executors share; an index opened again on its path goes on where it was. The
    tables are registered in the session's catalog, without which Spark doesn't read buckets as such.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS, block_classes: int = BLOCK_CLASSES) -> None:
        self.spark = spark
        self.path = path or shared_dir(spark, "linkage")
        self.block_classes = block_classes
        kept = self._kept("meta")
        self.buckets = kept["buckets"] if kept else buckets
        if not kept:
            self._keep("meta", {"buckets": buckets})
        mark = uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex
        self._blocks, self._parents = f"linkage_blocks_{mark}", f"linkage_parents_{mark}"
        by = f"into {self.buckets} buckets"
        spark.sql(f"create table if not exists {self._blocks} (key long, id long, account string, amount decimal(18,2), date date, text string, year int) using parquet partitioned by (year) clustered by (key) {by} location '{self.path}/blocks'")
        spark.sql(f"create table if not exists {self._parents} (id long, parent long) using parquet clustered by (id) {by} location '{self.path}/parents'")
        if kept:
            spark.sql(f"msck repair table {self._blocks}")
        weights = self._kept("weights")
        self.weights = Weights(tuple(map(tuple, weights["fields"])), weights["start"]) if weights else None

    def _kept(self, name: str) -> dict | None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/{name}").first()[0])

    def _keep(self, name: str, value: dict) -> None:
        self.spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{name}")

    def close(self) -> None:
        """Take the tables out of the session's catalog; what is under path stays."""
        self.spark.sql(f"drop table if exists {self._blocks}")
        self.spark.sql(f"drop table if exists {self._parents}")

    def accept(self, rows: DataFrame) -> None:
        """Append accepted records (see records()) to the blocking-key table: one exchange, one file for a bucket and year."""
        keyed = rows.select(_key(F.col("date")).alias("key"), *RECORD, F.year("date").alias("year"))
        keyed.repartition(self.buckets, "key").write.mode("append").insertInto(self._blocks)

    def blocks(self) -> DataFrame:
        return self.spark.table(self._blocks)

    def probe(self, batch: DataFrame) -> DataFrame:
        """Accepted records with a key of batch or of the days around it. The history isn't shuffled."""
        near = batch.select("account", "amount", "date").distinct().withColumn("date", _near_days())
        # The years of a batch are a handful; history of other years isn't read at all.
        years = [r[0] for r in near.select(F.year("date")).distinct().collect()]
        # The batch is laid out as the buckets are: else Spark might shuffle both sides for more tasks.
        keys = near.select(_key(F.col("date")).alias("key")).repartition(self.buckets, "key").distinct()
        return self.blocks().filter(F.col("year").isin(years)).join(keys, "key", "left_semi").select(*RECORD)

    def _classes(self, batch: DataFrame) -> DataFrame:
        """One row for records equal but for writing and order: the smallest id, their words, whether one is new."""
        both = self.probe(batch).withColumn("_new", F.lit(False)).unionByName(batch.select(*RECORD).withColumn("_new", F.lit(True)))
        grouped = both.withColumn("text", _words()).groupBy(*_BLOCK, "text")
        return grouped.agg(F.min("id").alias("rep"), F.max("_new").alias("_new"))

    def _pairs(self, classes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The pairs to compare, and the classes that meet by sub-blocks, if there are any."""
        sizes = classes.groupBy(*_BLOCK).agg(F.count("*").alias("n"), F.max("_new").alias("_new"))
        large = sizes.filter(F.col("n") > self.block_classes).select("account", "amount", _near_days().alias("date")).distinct()
        large = written(large, "large-blocks")
        if large.isEmpty():
            return _all_pairs(classes.filter("_new"), classes), None
        small = classes.join(large, list(_BLOCK), "left_anti")
        meeting = written(self._reachable(classes, large), "reachable")
        return _all_pairs(classes.filter("_new"), small).unionByName(_sub_block_pairs(meeting)), meeting

    def _reachable(self, classes: DataFrame, large: DataFrame) -> DataFrame:
        """The classes of large blocks, listed, and as askers the new ones of the days around them."""
        near = large.select("account", "amount", _near_days().alias("date")).distinct()
        listed = large.withColumn("_listed", F.lit(True))
        reached = classes.join(near, list(_BLOCK), "left_semi").join(listed, list(_BLOCK), "left")
        return reached.withColumn("_listed", F.coalesce("_listed", F.lit(False))).filter("_new or _listed")

    def link(self, batch: DataFrame) -> DataFrame:
        """(kept_id, in_id): rows of batch that repeat a record present, with the smallest id of those they repeat.

        Present are the accepted records and the rows of batch with a smaller id. Null and wordless texts are
        alike. Numbers that contradict each other never link. An empty batch or history gives no rows for its
        part; extra columns are ignored, texts are compared whole. Weights are learned once and then kept.
        """
        batch = written(batch.select(*RECORD), "batch")
        classes = written(self._classes(batch), "classes")
        pairs, meeting = self._pairs(classes)
        compared = written(_compared(pairs), "compared")
        if self.weights is None:
            # At most 75 combinations of levels come to the driver, whatever the number of pairs.
            counts = Counter({(r[0], r[1], r[2]): r[3] for r in compared.filter("small").groupBy("words", "numbers", "days").count().collect()})
            if meeting is not None:
                counts.update(large_counts(meeting, compared.filter("not small")))
            if counts:
                self.weights = learn_weights(sorted(counts.items()))
                self._keep("weights", {"fields": self.weights.fields, "start": self.weights.start})
        weights = self.weights or learn_weights([])
        linkable = (F.col("words") > 0) & (F.col("numbers") != CONFLICT)
        self.matches = compared.filter(linkable & (weights.total(F.col("words"), F.col("numbers"), F.col("days")) > 0)).select("a", "b")
        best = self.matches.groupBy("a").agg(F.min("b").alias("_b"))
        kept = classes.filter("_new").join(best, classes["rep"] == best["a"], "left").select(*_BLOCK, F.col("text").alias("_words"), F.least("rep", F.coalesce("_b", "rep")).alias("kept_id"))
        rows = batch.withColumn("_words", _words())
        return rows.join(kept, [*_BLOCK, "_words"]).filter("kept_id < id").select("kept_id", F.col("id").alias("in_id"))

    def edges(self, links: DataFrame) -> DataFrame:
        """links of the last batch with all other matches of its classes, for update_clusters()."""
        return links.select("kept_id", "in_id").unionByName(self.matches.select(F.least("a", "b").alias("kept_id"), F.greatest("a", "b").alias("in_id"))).distinct()

    def roots(self, ids: DataFrame) -> DataFrame:
        """(id, root) of ids, following parents up; an id of no cluster is its own root."""
        parents = self.spark.table(self._parents).select(F.col("id").alias("_at"), "parent")
        found = ids.select("id", F.col("id").alias("root"))
        while True:
            step = written(found.join(parents, found["root"] == parents["_at"], "left").select("id", F.coalesce("parent", "root").alias("root"), F.col("parent").isNotNull().alias("_moved")), "roots")
            found = step.select("id", "root")
            if step.filter("_moved").isEmpty():
                return found

    def representatives(self) -> DataFrame:
        """(id, root) of all records that belong to a cluster of several."""
        parents = self.spark.table(self._parents)
        return self.roots(parents.select("id").unionByName(parents.select(F.col("parent").alias("id"))).distinct())

    def update_clusters(self, links: DataFrame) -> DataFrame:
        """Join the clusters that links (kept_id, in_id) touch; (id, root) of the ends of links afterwards.

        The roots of the ends are found, the smallest label travels along the links between roots, doubling its
        reach each round, and each root that lost gets a parent: what is written is one row for each root or new
        record that moved, and no other cluster is read or written.
        """
        links = written(links.select("kept_id", "in_id"), "links")
        ends = links.select(F.explode(F.array("kept_id", "in_id")).alias("id")).distinct()
        known = written(self.roots(ends), "ends")
        side = lambda c, r: known.select(F.col("id").alias(c), F.col("root").alias(r))
        edges = links.join(side("kept_id", "u"), "kept_id").join(side("in_id", "v"), "in_id").select("u", "v").filter("u <> v")
        edges = written(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
        labels = written(edges.select(F.col("u").alias("n")).distinct().withColumn("root", F.col("n")), "labels")
        changed = True
        while changed:
            step = edges.join(labels.withColumnRenamed("n", "v"), "v").groupBy("u").agg(F.min("root").alias("_m"))
            step = labels.join(step, labels["n"] == step["u"], "left").select("n", F.col("root").alias("_old"), F.least("root", F.coalesce("_m", "root")).alias("root"))
            jump = labels.select(F.col("n").alias("root"), F.col("root").alias("_next"))
            moved = written(step.join(jump, "root", "left").select("n", "_old", F.least("root", F.coalesce("_next", "root")).alias("root")), "labels")
            changed = not moved.filter("root <> _old").isEmpty()
            labels = moved.select("n", "root")
        labels.filter("root <> n").select(F.col("n").alias("id"), F.col("root").alias("parent")).repartition(self.buckets, "id").write.mode("append").insertInto(self._parents)
        return self.roots(ends)
