"""Numbers, dates and markup as text."""

from __future__ import annotations

import datetime as dt
import html
from decimal import Decimal

DASH = "—"
#: Currencies shown by a symbol.
SYMBOLS = {"EUR": "€", "GBP": "£", "USD": "$"}


def escape(text: object) -> str:
    return html.escape(str(text), quote=True)


def money(value: Decimal, currency: str | None = None) -> str:
    lead = f"{escape(currency)}&nbsp;" if currency else ""
    return f"{'-' if value < 0 else ''}{lead}{abs(value):,.2f}"


def compact(value: float, currency: str | None = None) -> str:
    """1.2M, 3.4k, 56 or 7.89, by size."""
    size = abs(value)
    for least, unit, digits in ((1e6, "M", 1), (1e3, "k", 1), (10, "", 0), (0, "", 2)):
        if size >= least:
            scaled = size / least if unit else size
            break
    return (SYMBOLS.get(currency, f"{currency} ") if currency else "") + f"{scaled:.{digits}f}{unit}"


def percent(rate: float | None) -> str:
    return DASH if rate is None else f"{rate * 100:.1f}%"


def day(value: dt.date | None) -> str:
    return DASH if value is None else value.isoformat()


def tint(colour: str, share: float) -> str:
    """A hex colour mixed with white; share 0 is the colour, 1 is white."""
    parts = (int(colour[i : i + 2], 16) for i in (1, 3, 5))
    return "#" + "".join(f"{round(c + (255 - c) * share):02x}" for c in parts)


def rgba(colour: str, alpha: float) -> str:
    return "rgba(" + ",".join(str(int(colour[i : i + 2], 16)) for i in (1, 3, 5)) + f",{alpha:g})"
