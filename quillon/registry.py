"""Operators by name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from quillon.config import InputError, Result

OPERATORS: dict[str, Callable[..., Result]] = {}


def operator(name: str) -> Callable:
    def put(f: Callable[..., Result]) -> Callable[..., Result]:
        OPERATORS[name] = f
        return f

    return put


def load() -> dict[str, Callable[..., Result]]:
    """All operators; importing their modules registers them."""
    import quillon.operators.base
    import quillon.operators.experiment
    import quillon.operators.growth  # noqa: F401

    return OPERATORS


def run(name: str, df: Any = None, config: dict[str, Any] | None = None) -> Result:
    """An operator with a plain configuration. What is wrong with the input is an InputError."""
    known = load()
    if name not in known:
        raise InputError(f"no operator {name!r}; there are {', '.join(sorted(known))}")
    try:
        return known[name](df, **(config or {}))
    except InputError:
        raise
    except (TypeError, KeyError, ValueError) as e:
        raise InputError(f"{name}: {e}") from e
