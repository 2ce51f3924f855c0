"""Prompt templates compiled to one column expression.

Supported: ``{{.field}}``, ``{{.nested.field}}``, ``{{.}}``, ``{{if .field}}..{{else}}..{{end}}``
and ``{{range .items}}..{{end}}`` over a VARIANT payload.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .documents import scalar_text

_FALSY = r"^(null|false|\"\"|\[\]|\{\}|-?0(\.0+)?(E.*)?)$"
_TAG = re.compile(r"\{\{\s*(.*?)\s*\}\}", re.S)


def _lookup(dot: Column, ref: str) -> Column:
    keys = [k for k in ref.split(".") if k]
    return F.try_variant_get(dot, "$" + "".join(f"['{k}']" for k in keys), "variant") if keys else dot


def _shown(value: Column) -> Column:
    """Text of a value; arrays print as ``[a b]``, missing values as ``<no value>``."""
    items = F.try_variant_get(value, "$", "array<variant>")
    joined = F.concat(F.lit("["), F.array_join(F.transform(items, lambda v: scalar_text(v)), " ", "<nil>"), F.lit("]"))
    return F.coalesce(joined, scalar_text(value), F.lit("<no value>"))


def _truthy(value: Column) -> Column:
    """Present, and not null, false, zero, or an empty string, array or object."""
    return F.coalesce(~F.to_json(value).rlike(_FALSY), F.lit(False))


def _block(parts: list[str], at: int, dot: Column) -> tuple[Column, str, int]:
    """Compile ``parts[at:]`` (text and tags alternate) up to ``else``, ``end`` or the end."""
    out: list[Column] = []
    while at < len(parts):
        if at % 2 == 0:
            if parts[at]:
                out.append(F.lit(parts[at]))
            at += 1
            continue
        tag = parts[at]
        if tag in ("else", "end"):
            return _joined(out), tag, at + 1
        word, _, ref = tag.partition(" ")
        if word == "if":
            yes, stop, at = _block(parts, at + 1, dot)
            no = F.lit("")
            if stop == "else":
                no, stop, at = _block(parts, at, dot)
            out.append(F.when(_truthy(_lookup(dot, ref)), yes).otherwise(no))
        elif word == "range":
            text, at = _loop(parts, at + 1, _lookup(dot, ref))
            out.append(text)
        elif tag.startswith("."):
            out.append(_shown(_lookup(dot, tag)))
            at += 1
        else:
            raise ValueError(f"unsupported template tag: {tag!r}")
    return _joined(out), "", at


def _loop(parts: list[str], start: int, value: Column) -> tuple[Column, int]:
    """Repeat the block from ``start`` for every item of an array."""
    after = []

    def body(item: Column) -> Column:
        text, _, at = _block(parts, start, item)
        after.append(at)
        return text

    items = F.transform(F.try_variant_get(value, "$", "array<variant>"), body)
    return F.coalesce(F.array_join(items, ""), F.lit("")), after[0]


def _joined(out: list[Column]) -> Column:
    return F.concat(*out) if out else F.lit("")


def render(template: str, payload: Column) -> Column:
    """The template's text for each row's VARIANT payload."""
    text, stop, _ = _block(_TAG.split(template), 0, payload)
    if stop:
        raise ValueError(f"template has a stray {stop!r}")
    return text
