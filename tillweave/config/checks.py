"""A small declarative checker for parsed YAML."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Key:
    """What one key of a mapping may hold."""

    default: Any = None
    required: bool = False
    choices: Collection = ()
    kind: type | tuple | None = None
    test: Callable[[Any], bool] | None = None
    problem: str = "is not valid"


def check_mapping(raw: Any, keys: dict[str, Key], where: str, error: type[Exception], reserved: dict[str, str] | None = None) -> dict[str, Any]:
    """The values of raw with defaults filled in; error, which names keys only, where it breaks the spec."""
    if not isinstance(raw, dict):
        raise error(f"{where} must be a mapping")
    for name in raw:
        if reserved and name in reserved:
            raise error(f"{where}.{name} is reserved: {reserved[name]}")
    _refuse(error, where, "unknown key(s)", set(raw) - set(keys))
    _refuse(error, where, "missing key(s)", {k for k, spec in keys.items() if spec.required} - set(raw))
    out = {}
    for name, spec in keys.items():
        if name not in raw:
            out[name] = spec.default
            continue
        value = raw[name]
        if spec.choices and not (isinstance(value, str) and value in spec.choices):
            raise error(f"{where}.{name} must be one of {', '.join(map(str, spec.choices))}")
        if spec.kind and not isinstance(value, spec.kind):
            raise error(f"{where}.{name} {spec.problem}")
        if spec.test and not spec.test(value):
            raise error(f"{where}.{name} {spec.problem}")
        out[name] = value
    return out


def _refuse(error: type[Exception], where: str, problem: str, names: Iterable) -> None:
    if names := sorted(map(str, names)):
        raise error(f"{where}: {problem} {', '.join(names)}")
