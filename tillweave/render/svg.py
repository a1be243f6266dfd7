"""Self-contained SVG figures: stacked bars, lines, and flows between layers."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict

from tillweave.render.text import compact, escape, rgba, tint

WIDTH, HEIGHT, PAD = 960, 420, 60
PALETTE = ("#4269d0", "#efb118", "#ff725c", "#6cc5b0", "#3ca951", "#ff8ab7", "#a463f2", "#97bbf5", "#9c6b4e", "#9498a0")
LAYERS = ("income", "account", "category", "subcategory")
NOTICE, NEUTRAL = "#c2410c", "#8a8f98"


def _frame(body: list[str], height: int = HEIGHT) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {height}" role="img">' + "".join(body) + "</svg>"


def _label(x: float, y: float, text: str, anchor: str = "start") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" font-size="11" text-anchor="{anchor}">{escape(text)}</text>'


def stacked_bars(rows: list[tuple[str, str, float]]) -> str:
    """One bar per month, one band per category: (month, category, amount)."""
    months, names = sorted({m for m, _, _ in rows}), sorted({c for _, c, _ in rows})
    value = {(m, c): float(v) for m, c, v in rows}
    top = max((sum(value.get((m, c), 0) for c in names) for m in months), default=0) or 1
    step = (WIDTH - 2 * PAD - 180) / max(len(months), 1)
    out = []
    for i, m in enumerate(months):
        y = HEIGHT - PAD
        for k, c in enumerate(names):
            h = value.get((m, c), 0) / top * (HEIGHT - 2 * PAD)
            y -= h
            if h:
                out.append(f'<rect x="{PAD + i * step + 2:.1f}" y="{y:.1f}" width="{max(step - 4, 1):.1f}" height="{h:.1f}" fill="{PALETTE[k % len(PALETTE)]}"><title>{escape(m)} {escape(c)}: {value[m, c]:,.2f}</title></rect>')
        out.append(_label(PAD + (i + 0.5) * step, HEIGHT - PAD + 16, m, "middle"))
    for k, c in enumerate(names):
        out.append(f'<rect x="{WIDTH - 170}" y="{PAD + k * 16 - 9}" width="10" height="10" fill="{PALETTE[k % len(PALETTE)]}"/>' + _label(WIDTH - 155, PAD + k * 16, c))
    return _frame(out, max(HEIGHT, PAD + 16 * len(names) + 20))


def lines(series: dict[str, list[tuple[dt.date, float]]]) -> str:
    """One line per name over dates; names without points have none."""
    series = {n: sorted(p) for n, p in series.items() if p}
    points = [p for s in series.values() for p in s]
    if not points:
        return _frame([_label(WIDTH / 2, HEIGHT / 2, "no data", "middle")])
    days, values = [d.toordinal() for d, _ in points], [float(v) for _, v in points]
    x0, dx, y0, dy = min(days), (max(days) - min(days)) or 1, min(values), (max(values) - min(values)) or 1
    place = lambda d, v: f"{PAD + (d.toordinal() - x0) / dx * (WIDTH - 2 * PAD - 180):.1f},{HEIGHT - PAD - (float(v) - y0) / dy * (HEIGHT - 2 * PAD):.1f}"
    out = []
    for k, (name, line) in enumerate(series.items()):
        colour = PALETTE[k % len(PALETTE)]
        out.append(f'<polyline fill="none" stroke="{colour}" stroke-width="1.5" points="{" ".join(place(d, v) for d, v in line)}"/>')
        out.append(f'<rect x="{WIDTH - 170}" y="{PAD + k * 16 - 9}" width="10" height="10" fill="{colour}"/>' + _label(WIDTH - 155, PAD + k * 16, name))
    ends = (dt.date.fromordinal(x0), dt.date.fromordinal(x0 + dx))
    out += [_label(PAD, HEIGHT - PAD + 16, ends[0].isoformat()), _label(WIDTH - PAD - 180, HEIGHT - PAD + 16, ends[1].isoformat(), "end")]
    return _frame(out, max(HEIGHT, PAD + 16 * len(series) + 20))


def _hover(link: dict) -> str:
    """What a link tells: its ends, its rows and amount; of net transfers also what flowed with and against it."""
    said = f"{link['source']} to {link['target']}: {link['count']} rows, {float(link['value']):,.2f}"
    if link.get("gross_with") is not None:
        said += f" net ({float(link['gross_with']):,.2f} with, {float(link['gross_against']):,.2f} against)"
    return escape(said)


def flows(links: list[dict], nodes: list[dict], currency: str | None = None) -> str:
    """Layers of nodes, sized by what flows through, and ribbons between them.

    A ribbon has the hue of the end that tells most: its target where it leaves an account, else its source.

    links: source_layer, source, target_layer, target, value, count; nodes: layer, label, total, rank, y.
    """
    crowd = defaultdict(int)
    for n in nodes:
        crowd[n["layer"]] += 1
    height = max(HEIGHT, 26 * max(crowd.values(), default=1) + 2 * PAD)
    most = max((sum(float(n["total"]) for n in nodes if n["layer"] == layer) for layer in crowd), default=1) or 1
    column = {layer: PAD + i * (WIDTH - 2 * PAD - 160) / (len(LAYERS) - 1) for i, layer in enumerate(LAYERS)}
    spot, out, front = {}, [], []
    hue = {}
    for n in sorted(nodes, key=lambda n: (n["layer"], n["rank"])):
        key = (n["layer"], n["label"])
        name = n["label"].rpartition("/")[2] if n["layer"] == "subcategory" else n["label"]
        if n["label"].startswith("(") or n["label"].startswith("Transfers ("):
            hue[key] = NOTICE
        elif n["label"] in ("Other", "Other income"):
            hue[key] = NEUTRAL
        elif n["layer"] == "subcategory":
            hue[key] = tint(hue.get(("category", n["label"].partition("/")[0]), PALETTE[0]), 0.4)
        else:
            hue[key] = PALETTE[(n["rank"] - 1) % len(PALETTE)]
        y = PAD + float(n["y"]) * (height - 2 * PAD)
        size = max(float(n["total"]) / most * (height - 2 * PAD) * 0.5, 2)
        spot[key] = (column[n["layer"]], y)
        front.append(f'<rect x="{column[n["layer"]]:.1f}" y="{y - size / 2:.1f}" width="12" height="{size:.1f}" fill="{hue[key]}"/>' + _label(column[n["layer"]] + 16, y + 4, f"{name} · {compact(float(n['total']), currency)}"))
    for link in links:
        a, b = (link["source_layer"], link["source"]), (link["target_layer"], link["target"])
        if a in spot and b in spot:
            (x1, y1), (x2, y2) = spot[a], spot[b]
            middle = (x1 + x2) / 2 + (80 if x1 == x2 else 0)
            wide = max(float(link["value"]) / most * (height - 2 * PAD) * 0.5, 0.8)
            out.append(f'<path d="M{x1 + 12:.1f},{y1:.1f} C{middle:.1f},{y1:.1f} {middle:.1f},{y2:.1f} {x2:.1f},{y2:.1f}" fill="none" stroke="{rgba(hue[b if a[0] == "account" else a], 0.35)}" stroke-width="{wide:.1f}"><title>{_hover(link)}</title></path>')
    return _frame(out + front, height)
