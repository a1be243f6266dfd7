"""Categorisation rules: reading, validating and ordering them; Python patterns in Java's dialect."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from re import _parser
from typing import Any

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame

from tillweave.config.checks import Key, check_mapping
from tillweave.config.errors import RuleError

KINDS = ("exact", "contains", "prefix", "regex")
ANY_ACCOUNT = "any"
_TEXT = "must be a non-empty string"


def _filled(value: str) -> bool:
    return bool(value.strip())


SPEC = {
    "match": Key(required=True, choices=KINDS),
    "pattern": Key(required=True, kind=str, test=bool, problem=_TEXT),
    "category": Key(required=True, kind=str, test=lambda c: all(map(_filled, c.split("/"))), problem="must be a string without empty segments"),
    "account": Key(default=ANY_ACCOUNT, kind=str, test=bool, problem=_TEXT),
    "transfer": Key(default=False, kind=bool, problem="must be true or false"),
    "extract": Key(default=None, kind=(str, type(None)), test=lambda g: g is None or bool(g), problem="must be the name of a group"),
}


@dataclass(frozen=True)
class Rule:
    match: str
    pattern: str
    category: str
    account: str = ANY_ACCOUNT
    transfer: bool = False
    extract: str | None = None

    @property
    def java_pattern(self) -> str:
        return java_pattern(self.pattern)

    @property
    def group(self) -> int:
        """Number of the group that extract names."""
        return re.compile(self.pattern).groupindex[self.extract]

    @property
    def path(self) -> tuple[str, str]:
        """(category, subcategory): the first segment, and the others joined."""
        head, _, tail = self.category.partition("/")
        return head, tail


def java_pattern(pattern: str) -> str:
    """A pattern with Python's meaning in Java: plain groups, Unicode classes, and only a line feed ends a line."""
    plain = re.sub(r"\(\?P<\w+>", "(", pattern)
    for construct in ("(?P=", "(?(", "\\Z"):
        if construct in plain:
            raise RuleError("a pattern uses a construct that has no form in the engine's dialect")
    return "(?dU)" + plain


def required_literal(pattern: str) -> str:
    """The longest text that whatever the pattern fits must hold as it stands; blank if none is certain."""
    tree = _parser.parse(pattern)
    runs = [""]

    def walk(items: _parser.SubPattern) -> None:
        for op, value in items:
            if op is _parser.LITERAL:
                runs[-1] += chr(value)
                continue
            runs.append("")
            if op is _parser.SUBPATTERN and not value[1] & re.IGNORECASE:
                walk(value[3])
            elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and value[0]:
                walk(value[2])
            runs.append("")

    if not tree.state.flags & re.IGNORECASE:
        walk(tree)
    return max(runs, key=len)


def parse_rule(raw: Any, position: int, source: str) -> Rule:
    where = f"{source}: rule[{position}]"
    values = check_mapping(raw, SPEC, where, RuleError)
    values["category"] = values["category"].strip()
    rule = Rule(**values)
    if rule.extract and rule.match != "regex":
        raise RuleError(f"{where}: extract needs match: regex")
    if rule.match == "regex":
        try:
            groups = re.compile(rule.pattern).groupindex
        except re.error:
            raise RuleError(f"{where}: pattern is no regular expression") from None
        if rule.extract and rule.extract not in groups:
            raise RuleError(f"{where}: extract names a group that the pattern lacks")
    return rule


def valid_rules(rules: DataFrame) -> DataFrame:
    """rules, a table of them, with valid: whether each passes parse_rule(). A blank or null option counts as absent."""
    names = [n for n in SPEC if n in rules.columns]
    schema = ", ".join(f"`{n}` {kind}" for n, kind in rules.dtypes) + ", valid boolean"

    def passes(raw: dict) -> bool:
        try:
            parse_rule({k: v for k, v in raw.items() if v is not None and not (k == "extract" and v == "")}, 0, "rules")
        except RuleError:
            return False
        return True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in names))
            valid = pa.array([passes(dict(zip(names, row))) for row in rows], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, valid], names=[*batch.schema.names, "valid"])

    return rules.mapInArrow(run, schema)


def read_rules(path: str | Path) -> list[Rule]:
    """The rules of a YAML file in order; an empty file has none."""
    path = Path(path)
    try:
        raw = yaml.safe_load(path.read_text(encoding="utf-8"))
    except yaml.YAMLError as e:
        mark = getattr(e, "problem_mark", None)
        raise RuleError(f"{path.name}: not valid YAML" + (f" at line {mark.line + 1}" if mark else "")) from None
    if raw is None:
        return []
    if not isinstance(raw, list):
        raise RuleError(f"{path.name}: rules must be a list")
    return [parse_rule(r, i, path.name) for i, r in enumerate(raw)]


#: The structural rules that every chain ends with, in order.
BUILTIN = (
    Rule("regex", r"^NEPOSCHG(?P<currency>[A-Z]{3})\s\d+\.\d{2}$", "Fees/Card FX", "boi_current", extract="currency"),
    Rule("regex", r"^NEATMCHG(?P<currency>[A-Z]{3})\s\d+\.\d{2}$", "Fees/ATM", "boi_current", extract="currency"),
    Rule("prefix", "GOVT DUTY ATM", "Fees/ATM Tax", "boi_current"),
    Rule("prefix", "ATM", "Cash/ATM", "boi_current"),
    Rule("prefix", "TX", "Card Payment", "boi_current"),
    Rule("regex", r"\d{4}(?P<country>[A-Z]{2})", "Card Payment", "boi_current", extract="country"),
    Rule("contains", "SALARY", "Income/Salary", "boi_current"),
    Rule("regex", r"^Transfer (?:to|from) (?P<name>.+)$", "Transfer", "revolut_current", True, "name"),
)


def chain(personal: list[Rule]) -> list[Rule]:
    """Personal rules come before the built-in ones; the first that matches wins."""
    return [*personal, *BUILTIN]


def to_yaml(rules: list[Rule]) -> str:
    return yaml.safe_dump([{k: v for k, v in vars(r).items() if v is not None} for r in rules], sort_keys=False, allow_unicode=True)
