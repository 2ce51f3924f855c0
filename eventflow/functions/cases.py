"""CASE expressions from a list."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_case(cases: Iterable[tuple[Column, Column | str | int]], otherwise=None) -> Column:
    """Value of the first true condition, else ``otherwise`` (NULL by default)."""
    (condition, value), *rest = list(cases)
    out = F.when(condition, value)
    for condition, value in rest:
        out = out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


def constant_map(values: dict[str, str]) -> Column:
    """Map literal from a Python dict."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
