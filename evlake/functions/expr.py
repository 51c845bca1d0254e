"""Small helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kept(value: Column, holds: Callable[[Column], Column]) -> Column:
    """A generator of value where it holds, else of nothing: a filter after a select would work value out twice."""
    return F.explode(F.filter(F.array(value), holds))


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def compact_join(parts: list[Column] | Column, separator: str) -> Column:
    """Non-blank parts, trimmed, joined; null if there are none."""
    array = F.array(*parts) if isinstance(parts, list) else parts
    kept = F.filter(F.transform(array, lambda x: F.trim(x)), lambda x: x != "")
    return F.nullif(F.array_join(kept, separator), F.lit(""))
