"""Column builders: text to typed values, keys and labels. All stay inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillweave.config.errors import ProfileError

MONEY = "decimal(18,2)"
#: What sums of money are cast to, so that every engine gives the same type.
TOTAL = "decimal(38,2)"
UNCATEGORISED = "(uncategorised)"

#: Strptime directives and the letters of Spark's date patterns.
_DIRECTIVES = {"d": "d", "m": "M", "Y": "yyyy", "b": "MMM", "B": "MMMM", "H": "H", "M": "m", "S": "s", "%": "%"}

_NUMBER = r"^[+-]?(\d+(\.\d{0,2})?|\.\d{1,2})$"


def total(amount: Column | str) -> Column:
    """Exact sum of money; 0 where there are no rows."""
    return F.coalesce(F.sum(amount), F.lit(0)).cast(TOTAL)


def _bare_number(text: Column, thousands: str, decimal: str) -> tuple[Column, Column]:
    """(text without brackets, separators, blanks and a leading plus; whether it stood in brackets)."""
    tidy = F.trim(text)
    bracketed = tidy.rlike(r"^\(.*\)$")
    inner = F.when(bracketed, F.trim(F.substring(tidy, F.lit(2), F.length(tidy) - 2))).otherwise(tidy)
    if thousands:
        inner = F.replace(inner, F.lit(thousands), F.lit(""))
    if decimal and decimal != ".":
        inner = F.replace(inner, F.lit(decimal), F.lit("."))
    return F.regexp_replace(F.replace(inner, F.lit(" "), F.lit("")), r"^\+", ""), bracketed


def parse_money(text: Column, thousands: str = ",", decimal: str = ".") -> Column:
    """A number of the money grammar, null where blank, "-", "." or unreadable (see money_is_bad).

    Surrounding blanks go, "(x)" is minus x, thousands separators and inner blanks go, one leading plus
    goes. More than two decimals, exponents and non-finite numbers are unreadable, a deliberate narrowing.
    """
    bare, bracketed = _bare_number(text, thousands, decimal)
    value = F.when(bare.rlike(_NUMBER), bare.try_cast(MONEY))
    return F.when(bracketed, -value).otherwise(value).cast(MONEY)


def money_is_bad(text: Column, thousands: str = ",", decimal: str = ".") -> Column:
    """Whether a cell holds something that isn't a number, rather than nothing."""
    bare, _ = _bare_number(text, thousands, decimal)
    return text.isNotNull() & ~bare.isin("", "-", ".") & parse_money(text, thousands, decimal).isNull()


def date_pattern(strptime: str) -> str:
    """Spark's pattern for a strptime format; a year of two digits is refused, as it means other centuries."""

    def one(m: re.Match) -> str:
        if m[1] not in _DIRECTIVES:
            raise ProfileError(f"dates.format uses %{m[1]}, which is not supported")
        return _DIRECTIVES[m[1]]

    parts = re.split(r"(%.)", strptime)
    return "".join(one(re.fullmatch(r"%(.)", p)) if re.fullmatch(r"%.", p) else re.sub(r"([A-Za-z]+)", r"'\1'", p) for p in parts)


def parse_date(text: Column, strptime: str) -> Column:
    """The date of a cell, null where blank or unreadable (see date_is_bad); a time of day is dropped."""
    return F.to_date(F.try_to_timestamp(F.trim(text), F.lit(date_pattern(strptime))))


def date_is_bad(text: Column, strptime: str) -> Column:
    return text.isNotNull() & (F.trim(text) != "") & parse_date(text, strptime).isNull()


def parse_flag(text: Column) -> Column:
    """true or false in any case; null for anything else."""
    return F.when(F.lower(F.trim(text)) == "true", True).when(F.lower(F.trim(text)) == "false", False)


def flag_text(flag: Column) -> Column:
    return F.initcap(flag.cast("string"))


def month_key(date: Column | str) -> Column:
    return F.date_format(date, "yyyy-MM")


def category_label(category: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(category), F.lit("")), F.lit(UNCATEGORISED))


def income_label(category: Column, subcategory: Column) -> Column:
    return F.coalesce(F.nullif(subcategory, F.lit("")), F.nullif(category, F.lit("")), F.lit(UNCATEGORISED))


def path_head(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def path_tail(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def bracket_to_path(value: Column) -> Column:
    """`Parent (Child)` as `Parent/Child`; other values trimmed.

    The child is what stands between the first bracket that opens and the one that ends the value.
    """
    tidy = F.trim(value)
    opens, size = F.instr(tidy, "("), F.length(tidy)
    child = F.substring(tidy, opens + 1, size - opens - 1)
    nested = (opens > 0) & F.endswith(tidy, F.lit(")")) & (size - opens > 1)
    return F.when(nested, F.concat(F.trim(F.substring(tidy, F.lit(1), opens - 1)), F.lit("/"), F.trim(child))).otherwise(tidy)


def is_spend() -> Column:
    return ~F.col("is_transfer") & (F.col("amount") < 0)


def is_income() -> Column:
    return ~F.col("is_transfer") & (F.col("amount") > 0)


def in_range(first: str | None, last: str | None) -> Column:
    """Dated rows within both bounds, included; an absent bound is open."""
    keep = F.col("date").isNotNull()
    if first:
        keep = keep & (F.col("date") >= F.lit(first).cast("date"))
    if last:
        keep = keep & (F.col("date") <= F.lit(last).cast("date"))
    return keep


def wall_micros(time: Column) -> Column:
    """Microseconds since 1970 of a time without a zone, whatever the zone of the session."""
    seconds = F.unix_date(time.cast("date")).cast("long") * 86_400 + F.hour(time) * 3600 + F.minute(time) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("long")


def wall_time(instant: Column) -> Column:
    """The UTC wall clock of an instant, as a time without a zone: what wall_micros counts from."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
