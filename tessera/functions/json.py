"""Getters for JSON texts, with defaults; the first of several equal keys counts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def get_value(text: Column, path: str) -> Column:
    """The value at a path as JSON text; null if there is none."""
    return F.get_json_object(text, path)


def get_item(text: Column, index: int) -> Column:
    return F.get_json_object(text, f"$[{index}]")


def _default(found: Column, default) -> Column:
    return found if default is None else F.coalesce(found, F.lit(default))


def get_string(text: Column, path: str, default: str | None = None) -> Column:
    return _default(get_value(text, path), default)


def get_number(text: Column, path: str, default: float | None = None) -> Column:
    return _default(get_value(text, path).try_cast("double"), default)


def get_bool(text: Column, path: str, default: bool | None = None) -> Column:
    found = get_value(text, path)
    return _default(F.when(found == "true", F.lit(True)).when(found == "false", F.lit(False)), default)


def is_null(text: Column, path: str) -> Column:
    """Whether there is no value, or null, at a path."""
    return get_value(text, path).isNull()


def thousands(v: Column) -> Column:
    return F.format_number(v, 0)
