"""Request signatures as column expressions (keyed hashes built from ``sha2``, no Python rows)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Block size in bytes per digest size.
BLOCK_BYTES = {256: 64, 512: 128}
# Default age limit of a timestamped signature, in seconds.
TOLERANCE_SECONDS = 300
# Headers that may carry a signature, first non-empty one wins.
SIGNATURE_HEADERS = (
    "X-Signature-256",
    "X-Hub-Signature-256",
    "Stripe-Signature",
    "X-Slack-Signature",
)
# Scheme chosen by a word in the request path.
PATH_SCHEMES = (("stripe", "timestamped"), ("github", "sha256="), ("slack", "v0="))


def hmac_hex(secret: str, body: Column, bits: int = 256) -> Column:
    """Keyed hash of the body in lower-case hex; the two key pads are literals."""
    block = BLOCK_BYTES[bits]
    key = secret.encode()
    if len(key) > block:
        key = hashlib.new(f"sha{bits}", key).digest()
    key = key.ljust(block, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in key))
    outer = F.lit(bytearray(b ^ 0x5C for b in key))
    first = F.unhex(F.sha2(F.concat(inner, body.cast("binary")), bits))
    return F.sha2(F.concat(outer, first), bits)


def _missing(signature: Column) -> Column:
    return F.coalesce(signature, F.lit("")) == ""


def verify_plain(secret: str, body: Column, signature: Column, bits: int = 256) -> Column:
    """Verdict ``ok``/``missing``/``mismatch``; a ``sha256=`` or ``sha512=`` prefix is optional."""
    given = F.regexp_replace(F.regexp_replace(signature, "^sha256=", ""), "^sha512=", "")
    return (
        F.when(_missing(signature), F.lit("missing"))
        .when(given == hmac_hex(secret, body, bits), F.lit("ok"))
        .otherwise(F.lit("mismatch"))
    )


def verify_prefixed(secret: str, body: Column, signature: Column, prefix: str) -> Column:
    """The same with a mandatory prefix (``sha256=`` or ``v0=``); adds verdict ``no_prefix``."""
    return (
        F.when(_missing(signature), F.lit("missing"))
        .when(~signature.startswith(prefix), F.lit("no_prefix"))
        .when(signature == F.concat(F.lit(prefix), hmac_hex(secret, body)), F.lit("ok"))
        .otherwise(F.lit("mismatch"))
    )


def header_part(signature: Column, key: str) -> Column:
    """Value of ``key`` in ``k=v,k=v``; the last one wins, ``''`` when absent."""
    parts = F.filter(F.split(signature, ","), lambda p: p.startswith(key + "="))
    last = F.get(F.reverse(parts), F.lit(0))
    return F.coalesce(F.substr(last, F.lit(len(key) + 2)), F.lit(""))


def signed_text(signature: Column, body: Column) -> Column:
    """The text a timestamped signature covers: ``<t>.<body>``."""
    return F.concat(header_part(signature, "t"), F.lit("."), body)


def verify_timestamped(
    secret: str,
    body: Column,
    signature: Column,
    now: Column,
    tolerance: int = TOLERANCE_SECONDS,
) -> Column:
    """Verdict for ``t=<unix>,v1=<hex>`` headers; times in the future pass."""
    stamp, given = header_part(signature, "t"), header_part(signature, "v1")
    signed_at = F.when(stamp.rlike(r"^[+-]?[0-9]+$"), stamp).try_cast("bigint")
    age_us = F.unix_micros(now) - signed_at * F.lit(1_000_000)
    return (
        F.when(_missing(signature), F.lit("missing"))
        .when((stamp == "") | (given == ""), F.lit("bad_format"))
        .when(signed_at.isNull(), F.lit("bad_timestamp"))
        .when(age_us > tolerance * 1_000_000, F.lit("too_old"))
        .when(given == hmac_hex(secret, signed_text(signature, body)), F.lit("ok"))
        .otherwise(F.lit("mismatch"))
    )


def pick_header(headers: Column) -> Column:
    """First non-empty signature header of a header map, else ``''``."""
    values = [F.nullif(F.try_element_at(headers, F.lit(h)), F.lit("")) for h in SIGNATURE_HEADERS]
    return F.coalesce(*values, F.lit(""))


def pick_scheme(path: Column, has_secret: Column | bool = True) -> Column:
    """Scheme name by path word; plain keyed hash otherwise; ``none`` without a secret."""
    chosen = F.when(~(F.lit(has_secret) if isinstance(has_secret, bool) else has_secret), F.lit("none"))
    for word, scheme in PATH_SCHEMES:
        chosen = chosen.when(path.contains(word), F.lit(scheme))
    return chosen.otherwise(F.lit("plain"))


def verify_request(path: Column, secret: str | None, body: Column, headers: Column, now: Column) -> Column:
    """Verdict under the scheme the path selects; without a secret every request passes."""
    if not secret:
        return F.lit("ok")
    signature, scheme = pick_header(headers), pick_scheme(path)
    return (
        F.when(scheme == "timestamped", verify_timestamped(secret, body, signature, now))
        .when(scheme == "sha256=", verify_prefixed(secret, body, signature, "sha256="))
        .when(scheme == "v0=", verify_prefixed(secret, body, signature, "v0="))
        .otherwise(verify_plain(secret, body, signature))
    )
