"""Cleaning rules for raw JSON values, as expressions over VARIANT columns.

A raw value reaches these functions as a VARIANT: SQL NULL when the key is missing, a variant
null when the JSON says ``null``. The two differ for text fields, so both are kept apart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode counts as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

_INTEGER = r"^[+-]?[0-9]+(_[0-9]+)*$"
_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_ISO_TIME = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"([T ][0-9]{2}(:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
)
# Seconds of 0001-01-01 and of the end of 9999, the range of valid times.
_FIRST_SECOND, _LAST_SECOND = -62135596800, 253402300799


def strip(text: Column) -> Column:
    """Trim every kind of white space, not just blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def raw_value(record: Column, key: str) -> Column:
    return F.try_variant_get(record, f"$.{key}", "variant")


def value_text(value: Column) -> Column:
    """The value as text, trimmed; null for missing keys and JSON nulls."""
    return strip(F.try_variant_get(value, "$", "string"))


def value_kind(value: Column) -> Column:
    """Type of the value as a DDL name; ``VOID`` for a JSON null, null for a missing key."""
    return F.schema_of_variant(value)


def _number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def _is_numeric(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def clean_text(value: Column, text: Column, if_null: str = "") -> Column:
    """Trimmed text; a missing key gives ``""``, a JSON null gives ``if_null``."""
    is_boolean = text.isin("true", "false") & (value_kind(value) == "BOOLEAN")
    return (
        F.when(text.isNull(), F.when(F.is_variant_null(value), F.lit(if_null)).otherwise(F.lit("")))
        .when(is_boolean, F.initcap(text))
        .otherwise(text)
    )


def clean_int(value: Column, kind: Column, text: Column) -> Column:
    """Numbers are cut toward zero, text must be a whole number, all else is 0."""
    parsed = (
        F.when(_is_numeric(kind), _number(value).try_cast("int"))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int"))
        .when((kind == "STRING") & text.rlike(_INTEGER), F.replace(text, F.lit("_"), F.lit("")).try_cast("int"))
    )
    return F.coalesce(parsed, F.lit(0))


def finite_number(value: Column, kind: Column, text: Column) -> Column:
    """Numbers, booleans and numeric text as a double; null for anything else or infinite."""
    parsed = (
        F.when(_is_numeric(kind), _number(value))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int").cast("double"))
        .when((kind == "STRING") & text.rlike(_NUMBER), text.try_cast("double"))
    )
    return F.nullif(F.nullif(parsed, F.lit(float("inf"))), F.lit(float("-inf")))


def clean_double(number: Column) -> Column:
    return F.coalesce(number, F.lit(0.0))


def clean_bool(value: Column, kind: Column) -> Column:
    """Truthiness: non-zero numbers and any non-empty text, list or object are true."""
    written = F.try_variant_get(value, "$", "string")
    truth = (
        F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(_is_numeric(kind), _number(value) != 0)
        .when(kind == "STRING", written != "")
        .when(kind != "VOID", ~written.isin("[]", "{}"))
    )
    return F.coalesce(truth, F.lit(False))


def clean_timestamp(number: Column, kind: Column, text: Column, as_of: Column) -> Column:
    """Epoch seconds (number or numeric text), else ISO-8601 text, else ``as_of``.

    Text without a zone is read as UTC, provided the session time zone is UTC.
    """
    from_epoch = F.when(
        number.between(_FIRST_SECOND, _LAST_SECOND),
        F.timestamp_micros(F.round(number * 1e6).cast("bigint")),
    )
    from_iso = F.when((kind == "STRING") & text.rlike(_ISO_TIME), F.try_to_timestamp(text))
    return F.coalesce(from_epoch, from_iso, as_of.cast("timestamp"))


def join_content(title: Column, body: Column) -> Column:
    """Title and body, both trimmed already, with a blank between them where both have text."""
    return F.when(title == "", body).when(body == "", title).otherwise(F.concat(title, F.lit(" "), body))
