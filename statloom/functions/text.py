"""Text helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote_name(name: Column) -> Column:
    """Identifier in square brackets, closing brackets doubled."""
    return F.concat(F.lit("["), F.replace(name, F.lit("]"), F.lit("]]")), F.lit("]"))


def like_any_case(text: Column, pattern: str) -> Column:
    """LIKE that ignores case; ``_`` and ``%`` keep their wildcard meaning."""
    return text.ilike(pattern)


def in_any_case(text: Column, names: Iterable[str]) -> Column:
    """IN that ignores case."""
    return F.upper(text).isin([n.upper() for n in names])
