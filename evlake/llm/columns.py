"""Column helpers of the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word contracts, as a class of Java's patterns.
SPACES = r"[\x20\x09-\x0D]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, however often use mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES + "+"), "")


def unused_name(df: DataFrame, name: str) -> str:
    """name, or a longer one if df has a column of it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
