"""Columns computed exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pin(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add (or replace) expensive columns behind a boundary the optimizer does not copy them over.

    Spark substitutes a computed column into every later filter and projection that names it. In
    a chain of JSON steps these copies multiply with each step, and each copy parses again. A
    generator that yields one row per row stops the substitution, stays in generated code, and
    works on streams.
    """
    kept = [c for c in df.columns if c not in columns]
    one = F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))
    return df.select(*kept, F.inline(one))
