"""Profiles: how the columns of a source map to canonical fields."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from tillweave.config.checks import Key, check_mapping
from tillweave.config.errors import ProfileError
from tillweave.config.strategies import ALIGNS, AMOUNT_STYLES, BALANCE_CHECKS, DATE_FILLS, MULTILINES, PAGE_DETECTS, TABLE_ENDS
from tillweave.functions import coercions  # noqa: F401  (registers the strategies of columns)
from tillweave.sources import page_table  # noqa: F401  (registers those of pages)

#: The fields a source column may be mapped to.
FIELDS = ("date", "description", "amount", "in", "out", "balance", "currency")
_FIELD = Key(required=True, choices=FIELDS)
SPECS: dict[str, dict[str, Key]] = {
    "meta": {"name": Key(required=True), "institution": Key(required=True), "country": Key(required=True), "source": Key(required=True, choices=("pdf", "csv"))},
    "page_detect": {"strategy": Key("header_match", choices=PAGE_DETECTS)},
    "columns": {"header": Key(required=True), "field": _FIELD, "align": Key(required=True, choices=ALIGNS)},
    "table_end": {"strategy": Key("spacing_gap", choices=TABLE_ENDS), "text": Key()},
    "rows": {"line_tolerance": Key(3), "multiline": Key("merge_into_previous", choices=MULTILINES)},
    "amounts": {"style": Key("signed", choices=AMOUNT_STYLES), "thousands": Key(","), "decimal": Key(".")},
    "dates": {"format": Key("%Y-%m-%d"), "fill": Key("none", choices=DATE_FILLS)},
    "balance": {"present": Key(False), "validate": Key("none", choices=BALANCE_CHECKS)},
    "skip_rows": {"field": _FIELD, "equals": Key(required=True)},
    "csv": {"encoding": Key("utf-8"), "delimiter": Key(","), "column_map": Key(kind=dict, test=bool, problem="must be a mapping that isn't empty", required=True)},
}
RESERVED = {"dates": {"year_policy": "dates without a year are not supported, give a full format"}}
#: Sections of one kind of source only. Lists of sections hold one mapping per entry.
ONLY = {"pdf": ("page_detect", "columns", "table_end", "rows"), "csv": ("csv",)}
LISTS = ("columns", "skip_rows")
ALWAYS = ("amounts", "dates", "balance")


@dataclass(frozen=True)
class Column:
    header: str
    field: str
    align: str = "left_edge"


@dataclass(frozen=True)
class Profile:
    name: str
    source: str
    institution: str = ""
    country: str = ""
    columns: tuple[Column, ...] = ()
    page_detect: str = "header_match"
    table_end: str = "spacing_gap"
    footer: str | None = None
    line_tolerance: float = 3
    multiline: str = "merge_into_previous"
    style: str = "signed"
    thousands: str = ","
    decimal: str = "."
    date_format: str = "%Y-%m-%d"
    date_fill: str = "none"
    has_balance: bool = False
    check_balance: str = "none"
    skip: tuple[tuple[str, str], ...] = ()
    encoding: str = "utf-8"
    delimiter: str = ","
    column_map: dict[str, str] = field(default_factory=dict)

    @property
    def fields(self) -> set[str]:
        return {c.field for c in self.columns} if self.source == "pdf" else set(self.column_map.values())


def _section(raw: dict, name: str) -> Any:
    spec = SPECS[name]
    if name in LISTS:
        entries = raw.get(name)
        if entries is None and name == "skip_rows":
            return []
        if not isinstance(entries, list) or (name == "columns" and not entries):
            raise ProfileError(f"{name} must be a list" + (" that isn't empty" if name == "columns" else ""))
        return [check_mapping(e, spec, f"{name}[{i}]", ProfileError) for i, e in enumerate(entries)]
    value = raw.get(name)
    return check_mapping({} if value is None and name in ALWAYS else value, spec, name, ProfileError, RESERVED.get(name))


def parse_profile(raw: Any) -> Profile:
    """A validated profile; ProfileError, which names the setting, where it can't work."""
    if not isinstance(raw, dict):
        raise ProfileError("a profile must be a mapping")
    if unknown := sorted(set(map(str, raw)) - set(SPECS)):
        raise ProfileError(f"unknown section(s) {', '.join(unknown)}")
    if "meta" not in raw:
        raise ProfileError("section meta is missing")
    meta = _section(raw, "meta")
    source, other = meta["source"], "csv" if meta["source"] == "pdf" else "pdf"
    if wrong := [s for s in ONLY[other] if s in raw]:
        raise ProfileError(f"section {wrong[0]} belongs to {other} sources")
    if missing := [s for s in ONLY[source] if s not in raw]:
        raise ProfileError(f"missing section(s) {', '.join(missing)}")
    got = {name: _section(raw, name) for name in (*ONLY[source], *ALWAYS, "skip_rows")}
    end = got.get("table_end", {})
    if end.get("strategy") == "footer_text" and not end["text"]:
        raise ProfileError("table_end.text is needed by footer_text")
    if source == "csv" and (bad := [f for f in got["csv"]["column_map"].values() if f not in FIELDS]):
        raise ProfileError(f"csv.column_map has {len(bad)} target(s) that are no canonical field")
    profile = Profile(
        meta["name"],
        source,
        meta["institution"],
        meta["country"],
        tuple(Column(**c) for c in got.get("columns", ())),
        got.get("page_detect", {}).get("strategy", "header_match"),
        end.get("strategy", "spacing_gap"),
        end.get("text"),
        got.get("rows", {}).get("line_tolerance", 3),
        got.get("rows", {}).get("multiline", "merge_into_previous"),
        got["amounts"]["style"],
        got["amounts"]["thousands"],
        got["amounts"]["decimal"],
        got["dates"]["format"],
        got["dates"]["fill"],
        bool(got["balance"]["present"]),
        got["balance"]["validate"],
        tuple((s["field"], s["equals"]) for s in got["skip_rows"]),
        got.get("csv", {}).get("encoding", "utf-8"),
        got.get("csv", {}).get("delimiter", ","),
        dict(got.get("csv", {}).get("column_map", {})),
    )
    _consistent(profile)
    return profile


def _consistent(p: Profile) -> None:
    have = p.fields
    money = set(AMOUNT_STYLES[p.style].fields)
    needed = {"date", "description"} | money
    if lacking := sorted(needed - have):
        raise ProfileError(f"no column is mapped to {', '.join(lacking)} (amounts.style {p.style})")
    if extra := sorted(({"in", "out", "amount"} - money) & have):
        raise ProfileError(f"columns must not be mapped to {', '.join(extra)} with amounts.style {p.style}")
    if p.has_balance != ("balance" in have):
        raise ProfileError("balance.present must say whether a column is mapped to balance")
    if lost := sorted({f for f, _ in p.skip} - have):
        raise ProfileError(f"skip_rows uses unmapped field(s) {', '.join(lost)}")


def read_profile(path: str | Path) -> Profile:
    path = Path(path)
    try:
        return parse_profile(yaml.safe_load(path.read_text(encoding="utf-8")))
    except yaml.YAMLError:
        raise ProfileError(f"{path.name}: not valid YAML") from None


def find_profile(name: str, shipped: Path | None = None) -> Profile:
    """A profile by path, or by name among the shipped ones."""
    shipped = shipped or Path(__file__).parent / "profiles"
    for path in (Path(name), shipped / f"{name}.yaml"):
        if path.is_file():
            return read_profile(path)
    raise ProfileError(f"no profile of that name; shipped: {', '.join(sorted(p.stem for p in shipped.glob('*.yaml')))}")
