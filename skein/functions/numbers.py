"""Numbers, money and their comparison."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACES


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` where ``value`` stands in many places: bound as the item of an array, it is worked out once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def number_text(text: Column, money: bool = False) -> Column:
    """A number's text with its separators resolved: ``1.299,50 €`` and ``$1,299.50`` give ``1299.50``.

    With both separators the later one is the decimal point. A lone comma is one unless three digits follow; several
    dots group thousands; for money a lone dot before three digits does too. Null when it is no number.
    """
    bare = F.regexp_replace(F.regexp_replace(text, SPACES[:-2] + "A-Za-z$€£¥₹]", ""), r"^[^\d\-+.,]+|[^\d.,]+$", "")
    return once(bare, lambda b: _resolved(b, money))


def _resolved(bare: Column, money: bool) -> Column:
    from_end = F.reverse(bare)
    comma, dot = F.instr(from_end, ","), F.instr(from_end, ".")  # distance from the end; 0 without one
    no_dots, no_commas = F.replace(bare, F.lit("."), F.lit("")), F.replace(bare, F.lit(","), F.lit(""))

    def comma_as_point(value: Column) -> Column:
        return F.regexp_replace(value, r"^([^,]*),", "$1.")

    commas, dots = F.length(bare) - F.length(no_commas), F.length(bare) - F.length(no_dots)
    grouped = (dots > 1) | ((dots == 1) & (dot == 4)) if money else dots > 1
    resolved = (
        F.when((comma > 0) & (dot > 0), F.when(comma < dot, comma_as_point(no_dots)).otherwise(no_commas))
        .when(comma > 0, F.when((commas == 1) & (comma != 4), comma_as_point(bare)).otherwise(no_commas))
        .when(grouped, no_dots)
        .otherwise(bare)
    )
    return F.when(bare.rlike(r"^[-+]?[\d.,]+$") & bare.rlike(r"\d"), resolved)


def parse_number(text: Column, money: bool = False) -> Column:
    return number_text(text, money).try_cast("double")


def half_up(value: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d in binary arithmetic: halves go up, also below zero. ``round`` would use the
    decimal text of the double and differ."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def money_text(text: Column) -> Column:
    """Two-decimal text of an amount; null when it is none."""
    amount = half_up(parse_number(text, money=True), 2)
    return F.when(amount.isNotNull(), F.format_string("%.2f", amount))


def decimals(text: Column) -> Column:
    point = F.instr(text, ".")
    return F.when(point > 0, F.length(text) - point).otherwise(F.lit(0))


def rounds_to(a: Column, b: Column) -> Column:
    """Number texts agree when the one shown with fewer decimals (at least one) is the other rounded: within half a
    unit of its last decimal. Symmetric; whole numbers never round."""
    few, many = F.least(decimals(a), decimals(b)), F.greatest(decimals(a), decimals(b))
    gap = F.abs(a.try_cast("double") - b.try_cast("double"))
    return (few > 0) & (many > few) & (gap <= 0.5 * F.pow(F.lit(10.0), -few) + 1e-9)


def leading_number(text: Column) -> Column:
    """The number at the start of a text (``12abc`` is 12); null without one."""
    return F.regexp_extract(text, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double")


# Number words that quality checks and extraction read.
NUMBER_WORDS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}


def word_number(text: Column) -> Column:
    word = F.lower(F.trim(text))
    found = F.lit(None).cast("double")
    for name, number in NUMBER_WORDS.items():
        found = F.when(word == name, F.lit(float(number))).otherwise(found)
    return found


def nearly_equal(a: Column, b: Column, tolerance: float = 0.05) -> Column:
    """Cached values agree: equal but for case, or numbers less than ``tolerance`` of the larger apart. The difference
    is divided by the larger value itself, not its magnitude, so two negative numbers always agree and two zeros
    written differently never do."""
    x, y = (leading_number(F.regexp_replace(v, r"[^0-9.-]", "")) for v in (a, b))
    larger = F.greatest(x, y)
    close = F.when(larger != 0, F.abs(x - y) / larger < tolerance)
    return F.coalesce(F.lower(F.trim(a)) == F.lower(F.trim(b)), F.lit(False)) | F.coalesce(close, F.lit(False))


def number_renderings(value: Column) -> Column:
    """Usual ways to show a number: as it is, with one and with two decimals, each with either decimal mark and with
    or without groups of thousands."""
    plain = F.regexp_replace(F.format_string("%.10f", value), r"\.?0+$", "")

    def grouped(text: Column) -> Column:
        whole, rest = F.split_part(text, F.lit("."), F.lit(1)), F.regexp_extract(text, r"(\..*)$", 1)
        return F.concat(F.regexp_replace(whole, r"\B(?=(\d{3})+(?!\d))", ","), rest)

    texts = F.array(plain, F.format_string("%.1f", value), F.format_string("%.2f", value))
    points = F.flatten(F.transform(texts, lambda t: F.array(t, grouped(t))))
    return F.array_distinct(F.flatten(F.transform(points, lambda t: F.array(t, F.translate(t, ",.", ".,")))))


def number_shown(value: Column, text: Column) -> Column:
    """Some rendering of the number stands in the text as a token of its own: no digit or separator joins it on the
    left, no word character or further decimals on the right. A zero proves nothing and gives null."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?<![\d.,])(\d+(?:[.,]\d+)*)(?!\w)(?![.,]\d)"), F.lit(1))
    return once(value, lambda v: F.when(v != 0, F.arrays_overlap(number_renderings(F.abs(v)), tokens)))


def zero_shown(text: Column, words: Sequence[str]) -> Column:
    """A zero stands in the text right behind or before one of the field's own words (lower case, as the text is)."""
    named = "|".join(re.escape(w.lower()) for w in words)
    return text.rlike(rf"(?:{named})\s*:?\s*0(?!\d)|(?<!\d)0\s*(?:{named})") if named else F.lit(False)
