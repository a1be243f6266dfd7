"""Queries of the problems this package solves, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillweave.llm import byte_bpe, canon_map, fold_hash, leak_search, nearest_time, record_linkage, residue
from tillweave.session import table, written

P3_SQL = """
with f as (select entry_id, lower(trim(account)) account, amount, posted_at from feed_entries),
c as (select u.ord, f.entry_id, row_number() over (partition by u.ord order by abs(epoch_us(f.posted_at) - epoch_us(u.booked_at)), f.entry_id) k
      from unmatched u join f on f.account = lower(trim(u.account)) and f.amount = -u.amount
       and abs(epoch_us(f.posted_at) - epoch_us(u.booked_at)) <= 172800000000)
select ord, entry_id from c where k = 1
"""

_P5_WORDS = """
with w as (select *, list_aggregate(list_sort(regexp_extract_all(lower(coalesce(description, '')), '[\\p{L}\\p{N}]+')), 'string_agg', ' ') words from ledger),
g as (select ord, min(ord) over (partition by account, amount, date, words) head, count(*) over (partition by account, amount, date, words) copies from w)
"""


_P8_GRAMS = """
with dw as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from documents where text is not null),
iw as (select item_id, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') w from eval_items where passage is not null),
dg as (select distinct doc_id, array_to_string(w[i:i + 11], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 10)) i from dw)),
ig as (select distinct item_id, array_to_string(w[i:i + 11], ' ') g from (select item_id, w, unnest(range(1, len(w) - 10)) i from iw)),
f as (select distinct item_id, doc_id from ig join dg using (g))
"""


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    canon = table(spark, sf_dir, "canon")
    rules = canon_map.map_values(table(spark, sf_dir, "rules"), canon, "category", "category", "rule_id", canon_map.Spelling(alone="last"))
    book = canon_map.map_values(table(spark, sf_dir, "cashbook"), canon, "payee", "description", "entry_no", canon_map.Spelling(alone="first"))
    return rules.select(F.lit("rules").alias("src"), "row_id", "canon_id").unionByName(book.select(F.lit("cashbook").alias("src"), "row_id", "canon_id"))


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = p1_found(spark, sf_dir).filter("canon_id = 0")
    rules = table(spark, sf_dir, "rules").select(F.lit("rules").alias("src"), F.col("rule_id").alias("row_id"), F.col("category").alias("value"))
    book = table(spark, sf_dir, "cashbook").select(F.lit("cashbook").alias("src"), F.col("entry_no").alias("row_id"), F.col("description").alias("value"))
    return none.join(rules.unionByName(book), ["src", "row_id"]).groupBy("src", "value").agg(F.count("*").alias("rows"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    legs = table(spark, sf_dir, "unmatched").select("ord", "account", (-F.col("amount")).cast("decimal(18,2)").alias("amount"), "booked_at")
    feed = table(spark, sf_dir, "feed_entries").select("entry_id", "account", "amount", "posted_at")
    tidy = F.lower(F.btrim("account", F.lit(" \t\r\n\u00a0")))
    pairs = nearest_time.match_nearest(
        legs.withColumn("account", tidy), feed.withColumn("account", tidy), ("account", "amount"), "ord", "booked_at", "entry_id", "posted_at", tolerance_us=nearest_time.HOURS_48
    )
    return pairs.select(F.col("left_id").alias("ord"), F.col("right_id").alias("entry_id"))


def _linked(spark: SparkSession, sf_dir: str) -> tuple[record_linkage.LinkageIndex, DataFrame]:
    index = record_linkage.LinkageIndex(spark)
    index.accept(record_linkage.records(table(spark, sf_dir, "ledger"), "ord"))
    return index, index.link(record_linkage.records(table(spark, sf_dir, "incoming"), "in_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir)[1]


def p4_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of p4_found, by feeding the batches one after another into one index."""
    index = record_linkage.LinkageIndex(spark)
    index.accept(record_linkage.records(table(spark, sf_dir, "ledger"), "ord"))
    incoming = table(spark, sf_dir, "incoming")
    links = []
    # The batches of a delivery are a handful; each is linked, then accepted, before the next one is looked at.
    for (number,) in sorted(tuple(r) for r in incoming.select("batch_id").dropna().distinct().collect()):
        batch = record_linkage.records(incoming.filter(incoming["batch_id"] == number), "in_id")
        links.append(written(index.link(batch), "links"))
        index.accept(batch)
    return reduce(DataFrame.unionByName, links) if links else spark.createDataFrame([], "kept_id long, in_id long")


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, links = _linked(spark, sf_dir)
    index.update_clusters(index.edges(links))
    return index.representatives()


def _collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_hash.collapse(table(spark, sf_dir, "ledger"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collapsed(spark, sf_dir).select(F.col("_to").alias("first_ord"), F.col("_id").alias("copy_ord"))


def p5_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "ledger").select("ord", "account", "date", "amount", "description")
    return fold_hash.with_copies(rows, _collapsed(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(table(spark, sf_dir, "documents"))


def p7_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids with the first byte of each."""
    return byte_bpe.encode(table(spark, sf_dir, "documents"), with_offsets=True)


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leak_search.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.withColumn("item_id", F.col("item_id").cast("int"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).filter("run > 0").select("item_id", "doc_id")


def p8_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).filter("common > 0").select("item_id", "doc_id", "common", "answers")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(table(spark, sf_dir, "documents")).select("doc_id", "kind")


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return residue.without_residue(docs.select("doc_id", "lang", "source", "n_chars"), residue.find_residue(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_unmatched": p1_unmatched, "p3_found": p3_found, "p4_found": p4_found, "p4_batches": p4_batches, "p4_clusters": p4_clusters, "p5_found": p5_found, "p5_copies": p5_copies, "p7_ids": p7_ids, "p7_offsets": p7_offsets, "p8_found": p8_found, "p8_items": p8_items, "p8_paraphrases": p8_paraphrases, "p9_found": p9_found, "p9_clean": p9_clean}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": P3_SQL,
        "p8_found": _P8_GRAMS + "select item_id, doc_id from f",
        "p8_items": _P8_GRAMS + "select item_id, count(*) as documents from f group by item_id",
        "p5_found": _P5_WORDS + "select head as first_ord, ord as copy_ord from g where ord <> head",
        "p5_copies": _P5_WORDS + "select l.ord, l.account, l.date, l.amount, l.description, g.copies from g join ledger l using (ord) where g.ord = g.head",
    }
