"""One rule for empty cells: null and '' are empty; 0 and false are filled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_empty(value: Column) -> Column:
    """True for null and '' (never null itself)."""
    return value.isNull() | F.coalesce(value.cast("string") == "", F.lit(False))


def is_filled(value: Column) -> Column:
    return ~is_empty(value)


def is_present(value: Column) -> Column:
    """Wider rule of the field-coverage average: only null is missing, '' counts."""
    return value.isNotNull()


def is_blank(text: Column) -> Column:
    """Wider rule of the review report: null, white space only."""
    return F.coalesce(F.trim(text) == "", F.lit(True))


def blank_to_null(value: Column) -> Column:
    return F.when(is_filled(value), value)
