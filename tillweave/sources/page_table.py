"""One printed page: its lines, its header, the columns under it, and the rows of its table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from itertools import pairwise

import numpy as np

from tillweave.config.strategies import ALIGNS, MULTILINES, PAGE_DETECTS, TABLE_ENDS

MARGIN = 10
BELOW_HEADER = 5


@dataclass(frozen=True)
class Word:
    flow: int
    text: str
    x0: float
    x1: float
    top: float


@dataclass(frozen=True)
class Box:
    """The box of a column's header; x0 is None where the header can't be placed on its line."""

    field: str
    align: str
    x0: float | None
    x1: float | None
    top: float | None


@dataclass(frozen=True)
class PageRules:
    """What a profile says of pages, with its strategies looked up; this is what travels to the workers."""

    columns: tuple[tuple[str, str, str], ...]  # (header, field, align)
    tolerance: float
    footer: str | None
    aligns: dict[str, Callable] = field(default_factory=dict)
    detect: Callable | None = None
    ends: Callable | None = None
    multiline: Callable | None = None


@dataclass
class PrintedPage:
    words: Sequence[Word]  # in flow order
    width: float
    height: float
    rules: PageRules

    @cached_property
    def lines(self) -> dict[float, list[Word]]:
        """Words by rounded height, lines in the order of their first word's flow."""
        out: dict[float, list[Word]] = {}
        for w in self.words:
            out.setdefault(round(w.top, 1), []).append(w)
        return out

    @cached_property
    def boxes(self) -> list[Box] | None:
        """The headers' boxes in the declared order; None if the page has no table."""
        texts = {y: " ".join(w.text for w in line) for y, line in self.lines.items()}
        height = self.rules.detect(texts, [h for h, _, _ in self.rules.columns])
        if height is None:
            return None
        across = sorted(self.lines[height], key=lambda w: (w.x0, w.flow))
        texts_across = [w.text for w in across]
        out = []
        for header, name, align in self.rules.columns:
            parts = header.split()
            at = next((i for i in range(len(across) - len(parts) + 1) if texts_across[i : i + len(parts)] == parts), None)
            first, last = (across[at], across[at + len(parts) - 1]) if at is not None else (None, None)
            out.append(Box(name, align, first and first.x0, last and last.x1, first and first.top))
        return out

    @cached_property
    def placed(self) -> bool:
        return self.boxes is not None and all(b.x0 is not None for b in self.boxes)

    @property
    def header_top(self) -> float:
        return self.boxes[0].top

    @cached_property
    def bounds(self) -> list[tuple[str, float, float]]:
        """(field, from, to) of the columns: half-open, set between two headers as the right one's align says."""
        across = sorted(self.boxes, key=lambda b: (b.x0, b.field))
        edges = [0.0, *(float(self.rules.aligns[right.align](left, right)) for left, right in pairwise(across)), float(self.width)]
        return [(b.field, a, z) for b, (a, z) in zip(across, pairwise(edges))]

    @cached_property
    def table_lines(self) -> list[dict[str, str]]:
        """The lines between header and end of table with the text of each field; lines without any are gone."""
        bottom = self.rules.ends(self)
        inside = sorted((w for w in self.words if self.header_top + BELOW_HEADER < w.top < bottom), key=lambda w: (w.top, w.flow))
        out: list[dict[str, list[str]]] = []
        before = None
        for w in inside:
            if before is None or w.top - before >= self.rules.tolerance:
                out.append({name: [] for _, name, _ in self.rules.columns})
            before = w.top
            middle = (w.x0 + w.x1) / 2
            name = next((f for f, a, z in self.bounds if a <= middle < z), None)
            if name:
                out[-1][name].append(w.text)
        joined = [{f: " ".join(t) for f, t in line.items()} for line in out]
        return [line for line in joined if any(line.values())]

    @property
    def rows(self) -> list[dict[str, str]]:
        """The table's rows; those without a description are gone."""
        return [r for r in self.rules.multiline(self.table_lines) if r["description"].strip()]


@PAGE_DETECTS.add("header_match")
def header_match(texts: dict[float, str], headers: list[str]) -> float | None:
    """The first line, in flow order, that holds all headers."""
    return next((y for y, text in texts.items() if all(h in text for h in headers)), None)


@ALIGNS.add("left_edge")
def left_edge(left: Box, right: Box) -> float:
    return right.x0


@ALIGNS.add("midpoint")
def midpoint(left: Box, right: Box) -> float:
    return (left.x1 + right.x0) / 2


@ALIGNS.add("right_edge")
def right_edge(left: Box, right: Box) -> float:
    return right.x1


def _floor(page: PrintedPage) -> float:
    return page.height - MARGIN


@TABLE_ENDS.add("spacing_gap")
def spacing_gap(page: PrintedPage) -> float:
    """The line before the first gap that is over twice the upper median of the gaps below the header."""
    heights = np.unique(np.round([w.top for w in page.words if w.top > page.header_top + BELOW_HEADER], 1))
    gaps = np.diff(heights)
    wide = np.flatnonzero(gaps > 2 * np.sort(gaps)[gaps.size // 2]) if gaps.size else gaps
    return float(heights[wide[0]]) if wide.size else _floor(page)


@TABLE_ENDS.add("footer_text")
def footer_text(page: PrintedPage) -> float:
    """The first line below the header, in flow order, that holds the profile's text."""
    marked = (min(w.top for w in line) for line in page.lines.values() if page.rules.footer in " ".join(w.text for w in line))
    return next((top for top in marked if top > page.header_top), _floor(page))


TABLE_ENDS.add("page_bottom")(_floor)


@MULTILINES.add("merge_into_previous")
def merge_into_previous(lines: list[dict[str, str]]) -> list[dict[str, str]]:
    """Rows begin at lines that hold more than a description, and at the page's first; the descriptions up to the next are one."""
    begins = [k for k, line in enumerate(lines) if k == 0 or set(filter(line.get, line)) != {"description"}]
    told = [" ".join(line["description"] for line in lines[k:stop]).strip() for k, stop in pairwise([*begins, len(lines)])]
    return [lines[k] | {"description": text} for k, text in zip(begins, told)]


@MULTILINES.add("none")
def no_merging(lines: list[dict[str, str]]) -> list[dict[str, str]]:
    return lines
