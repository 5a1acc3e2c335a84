"""Numbers as text, and text with gaps filled in."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fixed(value: Column, digits: int) -> Column:
    """A number with a fixed count of decimals, rounded on its exact binary value, halves to even."""
    return F.call_function("format_number", value.cast("double"), F.lit("0." + "0" * digits if digits else "0"))


def padded(value: Column, width: int) -> Column:
    """A whole number with leading zeros; longer numbers stay whole."""
    text = value.cast("bigint").cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def fill(template: str, *values: Column) -> Column:
    """The template with each `{}` replaced in turn; null when any value is."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for value, text in zip(values, parts[1:], strict=True):
        out += [value.cast("string"), F.lit(text)]
    return F.concat(*out)
