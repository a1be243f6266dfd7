"""First-match categorisation by ordered rules."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillweave.config.rules import ANY_ACCOUNT, KINDS, Rule, java_pattern, required_literal
from tillweave.session import broadcast_if_small, written

#: Rules in one expression. Longer chains are cut into several, so generated methods stay compilable.
CHUNK = 100
#: Letters of a pattern that rules in a table are met by.
GRAM = 4


def condition(rule: Rule) -> Column:
    """Whether a row fits a rule: the account first, as it is cheap, then the pattern, always literal text."""
    text, pattern = F.col("description"), F.lit(rule.pattern)
    fits = {
        "exact": lambda: text == pattern,
        "contains": lambda: F.contains(text, pattern),
        "prefix": lambda: F.startswith(text, pattern),
        "regex": lambda: text.rlike(rule.java_pattern),
    }[rule.match]()
    return fits if rule.account == ANY_ACCOUNT else (F.col("account") == rule.account) & fits


def first_match(rules: list[Rule]) -> Column:
    """Position of the first rule that fits, -1 if none does."""
    chunks = [
        F.coalesce(*(F.when(condition(r), F.lit(i)) for i, r in enumerate(rules[k : k + CHUNK], k)))
        for k in range(0, len(rules), CHUNK)
    ]
    return F.coalesce(*chunks, F.lit(-1)) if chunks else F.lit(-1)


def _attribute(rules: list[Rule], value, column_type: str) -> Column:
    array = F.array(*(F.lit(value(r)).cast(column_type) for r in rules)) if rules else F.array(F.lit(None).cast(column_type))
    return F.when(F.col("_rule") >= 0, F.get(array, F.col("_rule")))


def _extracted(rules: list[Rule]) -> Column:
    """What the rule's group caught; null where it has none or caught nothing, which adds no segment."""
    caught = [F.when(F.col("_rule") == i, F.regexp_extract(F.col("description"), r.java_pattern, r.group)) for i, r in enumerate(rules) if r.extract]
    return F.nullif(F.coalesce(*caught), F.lit("")) if caught else F.lit(None).cast("string")


def categorise(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """rows with category, subcategory and is_transfer from the first rule that fits; blank where none does.

    Rules are tried on distinct (description, account) only, of which a ledger has far fewer than rows; the
    labels are joined back. Columns of those names that rows already has are replaced.
    """
    names = ("category", "subcategory", "is_transfer")
    plain = rows.drop(*names)
    keys = plain.select("description", "account").distinct()
    matched = keys.withColumn("_rule", first_match(rules)).withColumn("_caught", _extracted(rules))
    tail = F.concat_ws("/", F.nullif(_attribute(rules, lambda r: r.path[1], "string"), F.lit("")), F.col("_caught"))
    labelled = matched.select(
        F.col("description").alias("_d"),
        F.col("account").alias("_a"),
        F.coalesce(_attribute(rules, lambda r: r.path[0], "string"), F.lit("")).alias("category"),
        F.when(F.col("_rule") >= 0, tail).otherwise("").alias("subcategory"),
        F.coalesce(_attribute(rules, lambda r: r.transfer, "boolean"), F.lit(False)).alias("is_transfer"),
    )
    return plain.join(labelled, F.col("description").eqNullSafe(F.col("_d")) & F.col("account").eqNullSafe(F.col("_a")), "left").drop("_d", "_a")


def _met_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rules with the text that each row they fit must hold (blank if none is certain) and, for regex, Java's pattern."""
    for batch in batches:
        rules = list(zip(*(batch.column(n).to_pylist() for n in ("match", "pattern"))))
        literal = [required_literal(p) if m == "regex" else p for m, p in rules]
        java = [java_pattern(p) if m == "regex" else None for m, p in rules]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(literal, pa.string()), pa.array(java, pa.string())], names=[*batch.schema.names, "_literal", "_java"])


def categorise_by_table(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(ord, rule_id) of the first rule (least idx, then rule_id) that fits each row, for rule sets kept in a table.

    Exact rules join by hash on the description; contains and prefix rules join on the letters they begin
    with, regex rules on those of the longest text they must hold, so no row is tried against every rule.
    Only regex rules that need no certain text are tried on every distinct (description, account).
    """
    text = F.coalesce(F.col("description"), F.lit(""))
    keys = rows.select(text.alias("description"), "account").distinct()
    usable = rules.filter(F.col("pattern").isNotNull() & (F.col("pattern") != "") & F.col("match").isin(*KINDS)).select("rule_id", "idx", "match", "pattern", F.col("account").alias("_scope"))
    fits_account = (F.col("_scope") == ANY_ACCOUNT) | (F.col("_scope") == F.col("account"))
    # Written, so that its size is known and no branch is planned for kinds of rules that it lacks.
    schema = ", ".join(f"{n} {kind}" for n, kind in usable.dtypes) + ", _literal string, _java string"
    table = written(usable.mapInArrow(_met_by, schema), "rules")
    exact = keys.join(broadcast_if_small(table.filter("match = 'exact'")), (F.col("description") == F.col("pattern")) & fits_account)
    # A text that holds a pattern holds its first letters: rules are met by those, not one by one.
    inner = table.filter("match <> 'exact'").withColumn("_gram", F.substring("_literal", 1, GRAM))
    places = F.sequence(F.lit(1), F.greatest(F.length("description"), F.lit(1)))
    pieces = F.transform(places, lambda i: F.substring(F.col("description"), i, F.lit(GRAM)))
    grams = keys.withColumn("_gram", F.explode(F.array_distinct(pieces)))
    shorter = keys.withColumn("_gram", F.explode(F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(1), F.lit(GRAM - 1)), lambda n: F.substring(F.col("description"), i, n)))))))
    holds = F.contains("description", "_literal")
    fits_text = F.when(F.col("match") == "prefix", F.startswith("description", "pattern")).when(F.col("match") == "regex", holds & F.rlike("description", "_java")).otherwise(holds)
    size = F.length("_literal")
    long, short, open_ = inner.filter(size >= GRAM), inner.filter((size > 0) & (size < GRAM)), inner.filter(size == 0)
    branches = [exact, grams.join(broadcast_if_small(long), "_gram").filter(fits_account & fits_text)]
    if not short.isEmpty():
        branches.append(shorter.join(broadcast_if_small(short), "_gram").filter(fits_account & fits_text))
    if not open_.isEmpty():
        branches.append(keys.join(broadcast_if_small(open_), fits_account & fits_text))
    columns = ["description", "account", "idx", "rule_id"]
    found = reduce(DataFrame.unionByName, (f.select(columns) for f in branches))
    first = found.groupBy("description", "account").agg(F.min(F.struct("idx", "rule_id")).alias("_first"))
    return rows.withColumn("description", text).join(first, ["description", "account"]).select("ord", F.col("_first.rule_id").alias("rule_id"))


def uncategorised(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("category") == "")


def gate(rows: DataFrame, tolerance: str) -> DataFrame:
    """One row: the uncategorised rows, their sum of absolute amounts, and whether that stays within tolerance."""
    open_ = F.col("category") == ""
    money = F.coalesce(F.sum(F.when(open_, F.abs("amount"))), F.lit(0)).cast("decimal(38,2)")
    out = rows.agg(F.count("*").alias("rows"), F.count_if(open_).alias("uncategorised"), money.alias("amount"))
    return out.withColumn("passes", F.col("amount") <= F.lit(tolerance).cast("decimal(38,2)"))
