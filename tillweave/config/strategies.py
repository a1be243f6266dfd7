"""Named strategies: what profiles choose by name. More can be added by name, before profiles are read.

    @ALIGNS.add("third")
    def third(left, right):
        return left.x1 + (right.x0 - left.x1) / 3

Strategies of pages are plain functions over one page; they travel to the workers with the plan. Strategies of
columns build expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Registry(dict[str, Callable[..., Any]]):
    """Strategies of one kind by name."""

    def add(self, name: str) -> Callable[[Callable], Callable]:
        def keep(strategy: Callable) -> Callable:
            if name in self:
                raise ValueError(f"there is a strategy {name} already")
            self[name] = strategy
            return strategy

        return keep


#: (page's text lines, headers) -> the header line's height, or None where the page has no table.
PAGE_DETECTS = Registry()
#: (left header's box, right header's box) -> where the boundary between their columns lies.
ALIGNS = Registry()
#: (page) -> the height at which the table ends.
TABLE_ENDS = Registry()
#: (list of lines, each a dict of field texts) -> list of rows.
MULTILINES = Registry()
#: (date column, order column) -> filled date column.
DATE_FILLS = Registry()
#: (function from a field to its number) -> amount column.
AMOUNT_STYLES = Registry()
#: Name of a check of balances -> whether it runs; the check itself is over rows, not cells.
BALANCE_CHECKS = Registry()
#: Suffix of a page file -> function from its bytes to rows of the word table, without the file's name.
EXTRACTORS = Registry()
