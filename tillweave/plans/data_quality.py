"""Queries of the general data-quality problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillweave.operators.dyadic import periods_and_gaps
from tillweave.plans.registry import query
from tillweave.session import shared_dir, table
from tillweave.sources.strict_records import accepted, parse_records, read_records, rejected


# The grammar of a record as patterns: fields, then typed cells, in the order of the reasons.
_F = r"""(?:"(?:[^"]|"")*"|[^",][^,]*|)"""
_NUM = r"\\+?[+-]?(\\d+(\\.\\d{0,2})?|\\.\\d{1,2})".replace("\\\\", "\\")


def _cell(k: int) -> str:
    field = f"regexp_extract(raw, '^(?:{_F},){{{k}}}({_F})(?:,|$)', 1)"
    return f"case when {field} like '\"%' then replace(substr({field}, 2, length({field}) - 2), '\"\"', '\"') else {field} end"


def _is_number(c: str) -> str:
    bare = f"replace(case when trim({c}) like '(%)' then trim(substr(trim({c}), 2, length(trim({c})) - 2)) else trim({c}) end, ' ', '')"
    return f"regexp_full_match({bare}, '{_NUM}')"


_P2_REASONS = f"""
with r as (select line_id, regexp_replace(raw, '\\r$', '') raw from raw_lines where (line_no is null or line_no <> 1) and raw is not null and regexp_replace(raw, '[\\r\\n]', '', 'g') <> ''),
q as (select *, regexp_full_match(raw, '{_F}(?:,{_F})*') fine from r),
n as (select *, length(b) - length(replace(b, ',', '')) + 1 columns from (select *, regexp_replace(raw, '(^|,)"(?:[^"]|"")*"', '\\1q', 'g') b from q)),
c as (select *, {_cell(2)} d, {_cell(5)} a, {_cell(9)} l from n),
f as (select line_id, case when not fine then 'quoting' when columns <> 10 then 'column_count'
  when trim(d) <> '' and (not regexp_full_match(trim(d), '\\d{{4}}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d') or try_strptime(trim(d), '%Y-%m-%d %H:%M:%S') is null) then 'bad_date'
  when not {_is_number("a")} then 'bad_amount' when trim(l) not in ('', '-') and not {_is_number("l")} then 'bad_balance' end reason from c)
"""


@query("p2_found", _P2_REASONS + "select line_id, reason from f where reason is not null")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(parse_records(table(spark, sf_dir, "raw_lines")))


def _number(c: str) -> str:
    bare = f"replace(case when trim({c}) like '(%)' then trim(substr(trim({c}), 2, length(trim({c})) - 2)) else trim({c}) end, ' ', '')"
    value = f"try_cast(regexp_replace({bare}, '^\\+', '') as decimal(38,2))"
    return f"case when trim({c}) like '(%)' then -{value} else {value} end"


_P2_CANONICAL = f"""
, t as (select line_id, source_file, line_no, regexp_replace(raw, '\\r$', '') raw from raw_lines where line_id in (select line_id from f where reason is null)),
v as (select *, {_cell(2)} d, {_cell(4)} told, {_cell(5)} a, {_cell(7)} cur, {_cell(9)} l from t)
select line_id, source_file, (line_no - 1)::int as "row", case when trim(d) <> '' then strptime(trim(d), '%Y-%m-%d %H:%M:%S')::date end as date, regexp_replace(told, '^\\s+|\\s+$', '', 'g') as description,
  {_number("a")} as amount, {_number("l")} as balance, nullif(regexp_replace(cur, '^\\s+|\\s+$', '', 'g'), '') as currency from v
"""


@query("p2_canonical", _P2_REASONS + _P2_CANONICAL)
def p2_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted(parse_records(table(spark, sf_dir, "raw_lines")))


@query("p2_from_files", _P2_REASONS + "select coalesce(reason, 'none') as reason, count(*) as records from f where reason is distinct from 'quoting' group by 1")
def p2_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records written as a file and assembled again over their line breaks, all but those whose quotes never end."""
    lines = table(spark, sf_dir, "raw_lines")
    fine = parse_records(lines).filter("reason is distinct from 'quoting'").select("line_id")
    path = shared_dir(spark, "file")
    body = lines.join(fine, "line_id", "left_semi").select("line_id", F.col("raw").alias("line"))
    head = spark.range(1).select(F.lit(-1).cast("long").alias("line_id"), F.lit("header").alias("line"))
    head.unionByName(body).repartition(1).sortWithinPartitions("line_id").select("line").write.mode("overwrite").option("lineSep", "\n").text(path)
    return parse_records(read_records(spark, path)).groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("records"))


@query("p2_reasons", _P2_REASONS + "select reason, count(*) as records from f where reason is not null group by reason")
def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_found(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("records"))


P6_SQL = """
with s as (select distinct account, period_start lo, period_end hi from statements
           where period_start is not null and period_end is not null and period_start <= period_end),
m as (select *, max(hi) over (partition by account order by lo, hi rows between unbounded preceding and 1 preceding) reach from s),
g as (select *, sum(case when reach is null or lo > reach + 1 then 1 else 0 end) over (partition by account order by lo, hi rows unbounded preceding) run from m),
p as (select account, run, min(lo) lo, max(hi) hi from g group by account, run),
n as (select *, lead(lo) over (partition by account order by lo) nxt from p)
select account, 'period' as kind, strftime(lo, '%Y-%m-%d') as first_day, strftime(hi, '%Y-%m-%d') as last_day from p
union all
select account, 'gap', strftime(hi + 1, '%Y-%m-%d'), strftime(nxt - 1, '%Y-%m-%d') from n where nxt is not null
"""


@query("p6_found", P6_SQL)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods_and_gaps(table(spark, sf_dir, "statements"))
