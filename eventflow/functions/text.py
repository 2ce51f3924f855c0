"""Scalar text functions: substring test, byte sizes, durations, intervals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB = 1024

# Seconds per unit of an interval text.
UNIT_SECONDS = {
    "ns": 1e-9,
    "us": 1e-6,
    "µs": 1e-6,
    "μs": 1e-6,
    "ms": 1e-3,
    "s": 1.0,
    "m": 60.0,
    "h": 3600.0,
}
_STEP = r"((?:[0-9]+\.?[0-9]*)|(?:\.[0-9]+))(ns|us|µs|μs|ms|s|m|h)"


def contains(text: Column, part: str) -> Column:
    """Case-sensitive substring test."""
    return text.contains(part)


def _scaled(size: Column, power: int, digits: int, suffix: str) -> Column:
    value = F.bround(size.cast("double") / float(KIB**power), digits)
    return F.format_string(f"%.{digits}f{suffix}", value)


def format_bytes(size: Column) -> Column:
    """``16GB`` style: whole units up to GB, one decimal for TB, ties to even."""
    return (
        F.when(size >= KIB**4, _scaled(size, 4, 1, "TB"))
        .when(size >= KIB**3, _scaled(size, 3, 0, "GB"))
        .when(size >= KIB**2, _scaled(size, 2, 0, "MB"))
        .when(size >= KIB, _scaled(size, 1, 0, "KB"))
        .otherwise(F.format_string("%dB", size))
    )


def format_bytes_spaced(size: Column) -> Column:
    """``1.5 GB`` style: one decimal, a space, units from B to EB."""
    text = F.when(size < KIB, F.format_string("%d B", size))
    for power, unit in enumerate("KMGTP", start=1):
        text = text.when(size < KIB ** (power + 1), _scaled(size, power, 1, f" {unit}B"))
    return text.otherwise(_scaled(size, 6, 1, " EB"))


def format_duration(seconds: Column) -> Column:
    """Largest whole unit of s, m, h, d; the rest is cut off."""

    def whole(per: int, unit: str) -> Column:
        parts = (seconds / per).cast("bigint")
        return F.concat(parts.cast("string"), F.lit(unit))

    return (
        F.when(seconds < 60, whole(1, "s"))
        .when(seconds < 3600, whole(60, "m"))
        .when(seconds < 86400, whole(3600, "h"))
        .otherwise(whole(86400, "d"))
    )


def parse_interval(text: Column) -> Column:
    """Interval text such as ``1h30m`` or ``500ms`` to seconds; NULL when malformed."""
    body = F.regexp_replace(text, r"^[+-]", "")
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    numbers = F.regexp_extract_all(body, F.lit(_STEP), F.lit(1))
    units = F.regexp_extract_all(body, F.lit(_STEP), F.lit(2))
    factor = F.create_map(*[F.lit(x) for kv in UNIT_SECONDS.items() for x in kv])
    parts = F.zip_with(numbers, units, lambda n, u: n.cast("double") * factor[u])
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(body == "0", F.lit(0.0)).when(body.rlike(f"^({_STEP})+$"), sign * total)


def interval_seconds(text: str) -> float:
    """The same for an interval known when the plan is built."""
    body = text.lstrip("+-")
    if body == "0":
        return 0.0
    steps = re.findall(_STEP, body)
    if not steps or "".join(n + u for n, u in steps) != body:
        raise ValueError(f"not an interval: {text!r}")
    total = sum(float(n) * UNIT_SECONDS[u] for n, u in steps)
    return -total if text.startswith("-") else total


def interval_text(seconds: Column) -> Column:
    """Whole seconds as ``1h2m3s`` (larger units only when needed)."""
    total = seconds.cast("bigint")
    h, m, s = F.floor(total / 3600), F.floor(F.pmod(total, F.lit(3600)) / 60), F.pmod(total, F.lit(60))
    return (
        F.when(total >= 3600, F.format_string("%dh%dm%ds", h, m, s))
        .when(total >= 60, F.format_string("%dm%ds", m, s))
        .otherwise(F.format_string("%ds", s))
    )
