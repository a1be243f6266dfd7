"""Strategies of columns: how dates are filled and amounts are put together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tillweave.config.strategies import AMOUNT_STYLES, BALANCE_CHECKS, DATE_FILLS

Number = Callable[[str], Column]


def amount_style(name: str, *fields: str) -> Callable[[Callable], Callable]:
    """Register a style that reads these fields."""

    def keep(build: Callable[[Number], tuple[Column, Column]]) -> Callable:
        build.fields = fields
        return AMOUNT_STYLES.add(name)(build)

    return keep


@amount_style("in_out", "in", "out")
def in_out(number: Number) -> tuple[Column, Column]:
    """(amount, whether it is missing though needed): what came in less what went out, blanks being none."""
    return F.coalesce(number("in"), F.lit(0)) - F.coalesce(number("out"), F.lit(0)), F.lit(False)


@amount_style("signed", "amount")
def signed(number: Number) -> tuple[Column, Column]:
    return number("amount"), number("amount").isNull()


@DATE_FILLS.add("forward")
def forward(date: Column | str, order: str) -> Column:
    """The last date at or before a row of its file; leading blanks stay null."""
    upto = Window.partitionBy("source_file").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(date, ignorenulls=True).over(upto)


@DATE_FILLS.add("none")
def no_fill(date: Column | str, order: str) -> Column:
    return F.col(date) if isinstance(date, str) else date


@BALANCE_CHECKS.add("continuity")
def continuity() -> bool:
    return True


@BALANCE_CHECKS.add("none")
def no_check() -> bool:
    return False
