"""JSON documents: guards, typed access and text rendering on VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Texts below this size always fit a VARIANT.
VARIANT_FITS = 2 * 1024 * 1024


def decode(text: Column) -> Column:
    """Text to VARIANT; NULL when the text is not JSON, or too large (see ``too_large``)."""
    return F.try_parse_json(text)


def too_large(text: Column) -> Column:
    """Valid JSON that no VARIANT can hold (Spark's limit on its encoded size)."""
    long = F.octet_length(text) > VARIANT_FITS
    return F.coalesce(long & decode(text).isNull() & F.get_json_object(text, "$").isNotNull(), F.lit(False))


def encode(value: Column) -> Column:
    """Struct, map, array or VARIANT to JSON text, NULL fields kept."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def is_object(text: Column) -> Column:
    """Valid JSON whose top level is an object (valid JSON starting with a brace)."""
    return F.coalesce(text.rlike(r"^\s*\{") & decode(text).isNotNull(), F.lit(False))


def kind(value: Column) -> Column:
    """Type name of a VARIANT: STRING, BIGINT, DOUBLE, DECIMAL(..), BOOLEAN, VOID, OBJECT<..>, ARRAY<..>."""
    return F.schema_of_variant(value)


def string_field(document: Column, name: str) -> Column:
    """A top-level field, only if it is a JSON string (whose JSON text starts with a quote)."""
    quoted = F.to_json(field(document, name)).startswith('"')
    return F.when(quoted, F.try_variant_get(document, f"$['{name}']", "string"))


def field(document: Column, name: str) -> Column:
    """A top-level field as VARIANT (NULL when missing)."""
    return F.try_variant_get(document, f"$['{name}']", "variant")


def scalar_text(value: Column, null_text: str | None = None) -> Column:
    """Plain text of a VARIANT: strings unquoted, integral numbers without exponent.

    Objects and arrays give their JSON text, JSON null gives ``null_text``.
    """
    shown = F.try_variant_get(value, "$", "string")
    return shown if null_text is None else F.when(value.isNotNull(), F.coalesce(shown, F.lit(null_text)))


def path_text(text: Column, path: str) -> Column:
    """Value at a dot path as text, ``''`` for anything but a string, number or boolean.

    A leading ``$.`` or ``.`` is optional and only objects are walked.
    """
    for prefix in ("$.", "."):
        path = path.removeprefix(prefix)
    keys = [k for k in path.split(".") if k]
    if not path:
        return F.lit("")
    steps = "$" + "".join(f"['{k}']" for k in keys)
    value = F.try_variant_get(decode(text), steps, "variant")
    scalar = ~F.to_json(value).rlike(r"^[\[{]")
    return F.coalesce(F.when(scalar, F.try_variant_get(value, "$", "string")), F.lit(""))


def merge_fields(text: Column, fields: dict[str, Column]) -> Column:
    """JSON object text with the given string fields added or replaced."""
    entries = F.try_variant_get(decode(text), "$", "map<string,variant>")
    kept = F.map_filter(entries, lambda k, _v: ~k.isin(*fields))
    added = F.create_map(*[c for k, v in fields.items() for c in (F.lit(k), v.cast("variant"))])
    return F.to_json(F.map_concat(kept, added), {"ignoreNullFields": "false"})
