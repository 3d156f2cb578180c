"""Typed access to VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def child(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def as_text(v: Column) -> Column:
    """The value of a JSON string, NULL for every other JSON type."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def text_at(v: Column, path: str) -> Column:
    return as_text(child(v, path))


def flag_at(v: Column, path: str) -> Column:
    """True only for a JSON ``true``."""
    found = child(v, path)
    is_bool = F.schema_of_variant(found) == "BOOLEAN"
    return F.coalesce(F.when(is_bool, F.try_variant_get(found, "$", "boolean")), F.lit(False))


def array_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def is_present(v: Column) -> Column:
    """Present and not a JSON null."""
    return v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(False))


def entries_of(v: Column) -> Column:
    """Object entries, NULL for anything that is not an object. VARIANT keeps its keys in order."""
    return F.map_entries(F.when(is_object(v), F.try_variant_get(v, "$", "map<string,variant>")))


def show_value(v: Column) -> Column:
    """Display form: strings raw, numbers and booleans as text, containers as JSON."""
    return F.when(is_present(v), F.try_variant_get(v, "$", "string")).otherwise(F.lit("<nil>"))
