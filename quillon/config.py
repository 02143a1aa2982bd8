"""What operators take and give."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMITATION_SCHEMA = "op string, code string, detail string"


class InputError(ValueError):
    """The input or its configuration is at fault, not the program."""


@dataclass(frozen=True)
class Result:
    """Tidy tables by name, and one row (op, code, detail) for each limitation of them. All are lazy."""

    tables: Mapping[str, DataFrame]
    limitations: DataFrame

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def need(df: DataFrame, *columns: str | None) -> None:
    """Every column has to be there; known from the schema, before anything runs."""
    for c in columns:
        if not c:
            raise InputError("a field is not configured")
        if c not in df.columns:
            raise InputError(f"the table has no field {c!r}")


def predicate(df: DataFrame, spec: Mapping[str, Any] | None) -> Column:
    """All of ``field = value``, ``field in [values]`` or ``field between {"from": a, "to": b}``; true without a spec."""
    out = F.lit(True)
    for name, want in (spec or {}).items():
        need(df, name)
        c = F.col(f"`{name}`")
        if isinstance(want, Mapping):
            if "from" in want:
                out = out & (c >= F.lit(want["from"]))
            if "to" in want:
                out = out & (c <= F.lit(want["to"]))
        elif isinstance(want, (list, tuple, set)):
            out = out & c.isin(*want)
        else:
            out = out & (c == F.lit(want))
    return F.coalesce(out, F.lit(False))


def limitations(df: DataFrame, op: str, always: Iterable[tuple[str, str]] = (), when: Iterable[tuple[DataFrame, Column, str, str]] = ()) -> DataFrame:
    """Rows for what always holds, and for what holds if any row of a table meets a condition."""
    out = df.sparkSession.createDataFrame([(op, code, detail) for code, detail in always], LIMITATION_SCHEMA)
    for table, condition, code, detail in when:
        out = out.unionByName(table.agg(F.coalesce(F.max(condition), F.lit(False)).alias("_holds")).where("_holds").select(F.lit(op).alias("op"), F.lit(code).alias("code"), F.lit(detail).alias("detail")))
    return out
