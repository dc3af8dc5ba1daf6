"""Transforms, typed normalisation, equality and shape checks of cell values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates, numbers, text, urls

#: Types of the public contract.
TYPES = ("text", "number", "money", "boolean", "date", "url", "image", "text_list")


def normalize(kind: str, raw: Column, base: Column | None = None, fold: bool = True) -> Column:
    """The comparison form of a raw text as ``kind``, as a string; null if it is no value of that type."""
    forms = {
        "text": lambda: text.compare_text(raw, fold),
        "number": lambda: number_form(raw),
        "money": lambda: numbers.money_text(raw),
        "boolean": lambda: text.boolean_word(raw),
        "date": lambda: dates.day(raw),
        "url": lambda: urls.http_url(raw, base),
        "image": lambda: urls.http_url(raw, base),
        "text_list": lambda: text.list_key(raw),
    }
    return forms[kind]()


def number_form(raw: Column) -> Column:
    """Shortest text of a number: no trailing zeros, no point on whole numbers."""
    value = numbers.parse_number(raw)
    whole = F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("long").cast("string"))
    return F.coalesce(whole, value.cast("string"))


def values_equal(kind: str, a: Column, b: Column, base: Column | None = None, fold: bool = True) -> Column:
    """Equality by type; a value that does not parse equals nothing."""
    x, y = normalize(kind, a, base, fold), normalize(kind, b, base, fold)
    if kind == "image":
        same = urls.image_key(x) == urls.image_key(y)
    elif kind == "text":
        same = F.lower(x) == F.lower(y)
    elif kind == "number":
        same = (x == y) | numbers.rounds_to(numbers.number_text(a), numbers.number_text(b))
    else:
        same = x == y
    return F.coalesce(same, F.lit(False))


def render_value(kind: str, normal: Column) -> Column:
    """The typed value of a normalised text."""
    if kind in ("number", "money"):
        return normal.try_cast("double")
    if kind == "boolean":
        return normal == "true"
    if kind == "text_list":
        return F.split(normal, text.LIST_SEPARATOR)
    return normal


# What a cell of each type is called in messages.
TYPE_LABELS = {
    "text": "text",
    "number": "a number",
    "money": "a money amount",
    "boolean": "yes/no (or in stock/out of stock)",
    "date": "a date",
    "url": "a URL",
    "image": "an image URL",
    "text_list": "a comma-separated list",
}


def expected_error(kind: str, raw: Column) -> Column:
    """Message for an expected value that cannot be used, else null."""
    return (
        F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", "Expected value is required")
        .when(normalize(kind, raw).isNull(), f"Not {TYPE_LABELS[kind]}")
        .otherwise(F.lit(None).cast("string"))
    )


def cents_to_units(raw: Column) -> Column:
    """Whole cents as units; other texts as they are."""
    return F.when(F.trim(raw).rlike(r"^\d+$"), (F.trim(raw).try_cast("double") / 100).cast("string")).otherwise(raw)


def infer_transform(kind: str, raw: Column, expected: Column | None = None, fold: bool = True) -> Column:
    """The first of identity and cents_to_units that makes the raw text equal the expected one, or that makes it a
    value of the type at all where none is expected; null if neither does."""
    names = ["identity", "cents_to_units"] if kind in ("number", "money") else ["identity"]
    chosen = F.lit(None).cast("string")
    for name in reversed(names):
        value = cents_to_units(raw) if name == "cents_to_units" else raw
        fits = normalize(kind, value, fold=fold).isNotNull() if expected is None else values_equal(kind, value, expected, fold=fold)
        chosen = F.when(fits, name).otherwise(chosen)
    return chosen


# Captions of a page's controls and sections, which are no values.
UI_LABELS = r"(?i)^(customer reviews|reviews|ratings|add to cart|buy now|out of stock|in stock|details|specifications|description|features|overview)$"


def shape_check(raw: Column, kind: str, field: str | None = None) -> Column:
    """struct<ok, normalized, reason> for a raw text of an extraction type."""
    if kind == "number":
        cleaned = F.regexp_replace(raw, r"[$,€£¥\s]", "")
        number = cleaned.try_cast("double")
        reason = F.when(raw.isNull(), "null").when(number.isNull() | (cleaned == ""), "not numeric")
        normal = number.cast("string")
    elif kind == "string":
        tidy = F.trim(raw)
        reason = F.when(raw.isNull(), "null").when(tidy == "", "empty string").when(tidy.rlike(UI_LABELS), "looks like UI label")
        if field == "description":
            reason = reason.when(F.length(tidy) < 20, "description too short")
        normal = raw
    else:
        reason, normal = F.when(raw.isNull(), "null"), raw
    return F.struct(reason.isNull().alias("ok"), F.when(reason.isNull(), normal).alias("normalized"), reason.alias("reason"))


def in_refresh_range(kind: str, concept: str, now: Column, was: Column, factor: float = 5.0) -> Column:
    """A run's number may replace the stored one: positive, moved by at most ``factor`` either way, a rating within the
    scale the old one implies, a review count whole and never back to 0 (from 0 it may go anywhere). Other types may."""
    if kind not in ("money", "number"):
        return F.lit(True)
    new, old = (normalize(kind, v, fold=False).try_cast("double") for v in (now, was))
    moved = (new / old <= factor) & (old / new <= factor)
    if concept == "review_count":
        fits = F.when((new != F.floor(new)) | (new < 0), False).when(old == 0, True).when(new == 0, False).otherwise(moved)
    elif concept == "rating":
        scale = F.when(old <= 5, 5).when(old <= 10, 10).otherwise(100)
        fits = F.when((new <= 0) | (old <= 0) | (new > scale), False).otherwise(moved)
    else:
        fits = F.when((new <= 0) | (old <= 0), False).otherwise(moved)
    return F.coalesce(fits, F.lit(False))
