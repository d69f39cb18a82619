"""Values that are known when a statement is built or sent: run values, variables, tags and date texts."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Mapping
from typing import Any

from plumbline.errors import GuardRefused
from plumbline.functions.expressions import Expr, literal

_runs: list[tuple[str, Any]] = []


def run_value(function: Callable, *arguments: Any, **keywords: Any) -> Expr:
    """What a function gives now, as a literal; traced."""
    value = function(*arguments, **keywords)
    _runs.append((getattr(function, "__name__", "function"), value))
    return literal(value)


def traced() -> tuple[tuple[str, Any], ...]:
    """The run values since the start, by function name."""
    return tuple(_runs)


def variable(name: str, *, default: Any, values: Mapping[str, Any] | None = None) -> Expr:
    """A value given when the statement is built for sending, or its default."""
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise GuardRefused(f"{name!r} is no name of a variable.")
    return literal((values or {}).get(name, default))


def date_text(day: datetime.date | str) -> str:
    """A day as quoted text."""
    if isinstance(day, str):
        day = datetime.date.fromisoformat(day)
    return f"'{day.isoformat()}'"


def tag_text(value: Any, *, quoted: bool = True) -> str:
    """A value inside SQL text."""
    text = value.isoformat() if isinstance(value, datetime.date) else str(value)
    if not quoted:
        return text
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
