"""HTML pages: one figure, or the overview with its sections."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from tillweave.render.text import day, escape, money, percent

STYLE = "body{font:15px/1.5 system-ui,sans-serif;margin:0;background:#fafafa;color:#1c1c1c}main{max-width:1040px;margin:auto;padding:24px}section{background:#fff;border:1px solid #e3e3e3;border-radius:8px;padding:16px 20px;margin:16px 0}table{border-collapse:collapse;width:100%}td,th{padding:4px 8px;text-align:left;border-bottom:1px solid #eee}td.n{text-align:right;font-variant-numeric:tabular-nums}.tiles{display:flex;gap:16px;flex-wrap:wrap}.tile b{display:block;font-size:22px}svg{width:100%;height:auto}"


def document(title: str, body: str) -> str:
    return f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title><style>{STYLE}</style></head>\n<body><main>\n{body}\n</main></body></html>\n'


def section(anchor: str, title: str, body: str) -> str:
    return f'<section id="{anchor}"><h2>{escape(title)}</h2>{body}</section>'


def rows_table(head: Sequence[str], rows: Sequence[Sequence[str]], numeric: Sequence[int] = ()) -> str:
    """A table of cells that are already text safe for markup."""
    cells = "".join("<tr>" + "".join(f'<td{" class=n" if i in numeric else ""}>{c}</td>' for i, c in enumerate(r)) + "</tr>" for r in rows)
    return "<table><tr>" + "".join(f"<th>{escape(h)}</th>" for h in head) + f"</tr>{cells}</table>" if rows else "<p>none</p>"


def overview(data: dict) -> str:
    """The overview page. data holds small rows: tiles, categories, merchants, movers, notables, health, coverage."""
    t, cur = data["tiles"], data["tiles"]["currency"]
    span = f"{day(data['first'])} to {day(data['last'])}"
    parts = [
        section("header", f"Spending overview: {span}", f"<p>{len(data['accounts'])} account(s): {escape(', '.join(data['accounts']))}. Made {escape(data['made'].strftime('%Y-%m-%d %H:%M'))}.</p>"),
        section("stat-tiles", "In short", '<div class="tiles">' + "".join(f'<div class="tile">{escape(n)}<b>{v}</b></div>' for n, v in (("Income", money(t["income"], cur)), ("Spend", money(t["spend"], cur)), ("Net", money(t["net"], cur)), ("Savings rate", percent(t["savings_rate"])))) + "</div>"),
        section("sankey", "Where the money went", data["flows"]),
    ]
    moved = "<p>No rows in the window before, so there is nothing to compare with.</p>" if not data["covered"] else rows_table(("Category", "Now", "Before", "Change"), [(escape(m["category"]), money(m["current"], cur), money(m["prior"], cur), money(m["delta"], cur)) for m in data["movers"]], (1, 2, 3))
    ranked = "".join(f"<h3>{title}</h3>" + rows_table((title, "Amount"), [(escape(r[key]), money(r["amount"], cur)) for r in data[name]], (1,)) for title, name, key in (("Categories", "categories", "category"), ("Merchants", "merchants", "merchant")))
    parts.append(section("rankings-movers", "Rankings and changes", ranked + "<h3>Changes</h3>" + moved))
    trends = (f'<div id="monthly-trend">{data["monthly"]}</div>' if data["monthly"] else "") + data["savings"]
    parts.append(section("trends", "Trends", trends))
    parts.append(section("notables", "Largest rows", rows_table(("Date", "Description", "Account", "Category", "Amount"), [(day(n["date"]), escape(n["description"]), escape(n["account"]), escape(n["category"]), money(n["amount"], cur)) for n in data["notables"]], (4,))))
    h = data["health"]
    parts.append(section("data-health", "Data health", f"<p>{h['uncategorised']} uncategorised row(s), {money(h['amount'], cur)} in all; {data['unmatched']} unmatched transfer(s).</p>" + rows_table(("Account", "From", "To", "Rows"), [(escape(c["account"]), day(c["first_date"]), day(c["last_date"]), str(c["rows"])) for c in data["coverage"]], (3,))))
    return document(f"Spending overview: {span}", "\n".join(parts))


def months_touched(first: dt.date, last: dt.date) -> int:
    return (last.year - first.year) * 12 + last.month - first.month + 1
