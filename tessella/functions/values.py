"""Value tests with three-way logic: absent, JSON null and falsy values are told apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# JSON texts that count as false.
FALSY = ["null", '""', "[]", "{}", "0", "0.0", "-0.0", "false"]


def field(props: Column, name: str) -> Column:
    """A field of a variant object: NULL if absent, a variant null if it is JSON null."""
    return F.try_variant_get(props, f"$['{name}']", "variant")


def present(props: Column, name: str) -> Column:
    return field(props, name).isNotNull()


def is_falsy(v: Column) -> Column:
    """Absent, null, empty text, empty list or object, zero or false."""
    return F.coalesce(F.to_json(v).isin(FALSY), F.lit(True))


def is_na(v: Column) -> Column:
    """Whether a variant is exactly the text 'N/A'."""
    return F.coalesce(F.to_json(v) == '"N/A"', F.lit(False))


def text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def blank(text: Column) -> Column:
    """NULL or empty text."""
    return text.isNull() | (text == "")


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100, and 0.0 for an empty whole."""
    return F.coalesce(F.try_divide(part, whole) * 100, F.lit(0.0))


def python_list(v: Column) -> Column:
    """A variant as the text Python prints for it: lists in brackets with single quotes, texts bare."""
    items = F.try_variant_get(v, "$", "array<variant>")
    one = F.transform(items, lambda x: F.when(F.coalesce(F.is_variant_null(x), F.lit(True)), "None").when(F.to_json(x).startswith('"'), F.concat(F.lit("'"), F.try_variant_get(x, "$", "string"), F.lit("'"))).otherwise(F.to_json(x)))
    return F.when(items.isNotNull(), F.concat(F.lit("["), F.array_join(one, ", "), F.lit("]"))).otherwise(F.try_variant_get(v, "$", "string"))
