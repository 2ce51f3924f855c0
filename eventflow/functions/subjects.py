"""Hierarchical subjects: dot-separated tokens, ``*`` for one token, trailing ``>`` for one or more.

One rule, whichever way a match is computed: a pattern without wildcards matches its own text; one with
wildcards matches only subjects without empty tokens (empty text, a dot at an end, two dots in a row).
Any other character, line breaks included, is part of a token.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .documents import scalar_text


def no_empty_token(subject: Column) -> Column:
    return (F.length(subject) > 0) & ~subject.startswith(".") & ~subject.endswith(".") & ~subject.contains("..")


def literal_prefix(pattern: str) -> str:
    """The text every match starts with, up to the first wildcard token."""
    tokens = pattern.split(".")
    for i, token in enumerate(tokens):
        if token == "*" or (token == ">" and i == len(tokens) - 1):
            return ".".join(tokens[:i]) + "." if i else ""
    return pattern


def subject_match(subject: Column, pattern: str) -> Column:
    """Does the subject match a pattern known when the plan is built?

    Literal patterns become an equality and wildcard patterns start with a prefix test, so
    both reach the parquet scan; the regular expression only settles what is left.
    """
    prefix = literal_prefix(pattern)
    if prefix == pattern:
        return subject == F.lit(pattern)
    hit = no_empty_token(subject)
    if prefix:
        hit = subject.startswith(prefix) & hit
    rest = pattern[len(prefix):]
    if rest == ">":
        return hit & (F.length(subject) > len(prefix))
    tokens = [r"[^.]+" if token == "*" else re.escape(token) for token in rest.split(".")]
    if rest.endswith(".>"):
        tokens[-1] = r".+"
    return hit & F.substring(subject, len(prefix) + 1, F.length(subject)).rlike(r"(?s)\A" + r"\.".join(tokens) + r"\z")


def inventory_match(subject: Column, pattern: str) -> Column:
    """The fleet inventory's own, simpler rule.

    Equal text; or a ``.>`` ending taken as a literal prefix; or equally many tokens with
    ``*`` for any one. A pattern that mixes ``*`` with a ``.>`` ending matches only its own text.
    """
    same = subject == F.lit(pattern)
    if pattern.endswith(".>"):
        return same | subject.startswith(pattern[:-1])
    if "*" not in pattern:
        return same
    tokens = pattern.split(".")
    parts = F.split(subject, r"\.")
    hit = F.size(parts) == len(tokens)
    for i, token in enumerate(tokens):
        if token != "*":
            hit = hit & (F.get(parts, F.lit(i)) == F.lit(token))
    return same | hit


def with_prefix(text: Column, prefix: str) -> Column:
    """Add the log's prefix unless it is there already."""
    return F.when(text.startswith(prefix), text).otherwise(F.concat(F.lit(prefix), text))


def scan_pattern(pattern: str, prefix: str) -> str:
    """Reader-side pattern: empty means everything, and the prefix is implied."""
    if not pattern:
        return prefix + ">"
    return pattern if pattern.startswith(prefix) else prefix + pattern


def resolve_subject(template: str, document: Column) -> Column:
    """Replace each ``{field}`` by the document's value; unknown fields keep the placeholder.

    ``document`` is a VARIANT column holding the output object.
    """
    pieces = []
    for text in re.split(r"(\{\w+\})", template):
        if not text:
            continue
        if re.fullmatch(r"\{\w+\}", text):
            value = F.try_variant_get(document, f"$['{text[1:-1]}']", "variant")
            pieces.append(F.coalesce(scalar_text(value, null_text="<nil>"), F.lit(text)))
        else:
            pieces.append(F.lit(text))
    return F.concat(*pieces) if pieces else F.lit("")
