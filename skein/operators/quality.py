"""Quality checks by type: a cleaned value and its issues, as expressions over raw texts.

Each check gives struct<value: string, issues: array<struct<severity, message, fixed>>>. Null cells have no issues.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.numbers import NUMBER_WORDS, leading_number
from skein.functions.text import SPACES
from skein.functions.urls import host

_ISSUES = "array<struct<severity: string, message: string, fixed: boolean>>"


def _issue(severity: str, message: Column | str, fixed: bool = False) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(severity).alias("severity"), text.alias("message"), F.lit(fixed).alias("fixed"))


def _result(raw: Column, value: Column, issues: Sequence[Column]) -> Column:
    found = F.when(raw.isNull(), F.array().cast(_ISSUES)).otherwise(F.array_compact(F.array(*issues)).cast(_ISSUES))
    return F.struct(value.alias("value"), found.alias("issues"))


def price(raw: Column) -> Column:
    """Every comma is dropped (unlike the locale-aware money type); below 0 and above a million are errors."""
    number = leading_number(F.regexp_replace(raw, r"[^0-9.\-]", ""))
    issues = [
        F.when(number.isNull(), _issue("error", F.concat(F.lit('Price is not a valid number: "'), raw, F.lit('"')))),
        F.when(number.isNotNull(), _issue("warning", "Price parsed from string", True)),
        F.when(number < 0, _issue("error", "Price is negative")).when(number == 0, _issue("warning", "Price is zero (may be intentional)")).when(
            number > 1_000_000, _issue("error", "Price is unreasonably high")
        ),
    ]
    return _result(raw, F.coalesce(number.cast("string"), raw), issues)


def string(raw: Column, longest: int = 5000) -> Column:
    """Tags become blanks and white space collapses; nothing left is an error."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(raw, "<[^>]+>", " "), SPACES, " "))
    changed = bare != raw
    issues = [
        F.when(changed & (bare == ""), _issue("error", "String is empty after stripping HTML")).when(changed, _issue("warning", "Stripped HTML tags from value", True)),
        F.when(F.length(bare) > longest, _issue("warning", F.concat(F.lit("String is very long ("), F.length(bare), F.lit(" chars) — may be wrong element")))),
    ]
    return _result(raw, bare, issues)


def url(raw: Column) -> Column:
    tidy = F.trim(raw)
    schemed = tidy.startswith("http://") | tidy.startswith("https://")
    issues = [
        F.when(tidy != raw, _issue("warning", "Trimmed whitespace from URL", True)),
        F.when(~schemed, _issue("error", F.concat(F.lit('URL does not start with http(s): "'), F.substring(tidy, 1, 60), F.lit('"')))).when(
            host(tidy).isNull(), _issue("error", F.concat(F.lit('URL is not parseable: "'), F.substring(tidy, 1, 60), F.lit('"')))
        ),
    ]
    return _result(raw, tidy, issues)


def number(raw: Column) -> Column:
    """A number word anywhere in the text counts before digits do."""
    word = F.regexp_extract(F.lower(raw), rf"\b({'|'.join(NUMBER_WORDS)})\b", 1)
    named = F.element_at(F.create_map(*[F.lit(x) for k, v in NUMBER_WORDS.items() for x in (k, float(v))]), word)
    parsed = leading_number(F.replace(raw, F.lit(","), F.lit("")))
    issues = [
        F.when(named.isNotNull(), _issue("warning", "Parsed word number", True))
        .when(parsed.isNull(), _issue("error", F.concat(F.lit('Not a valid number: "'), raw, F.lit('"'))))
        .otherwise(_issue("warning", "Parsed number from string", True)),
        F.when(named.isNull() & (F.abs(parsed) > 1e9), _issue("error", "Number is unreasonably large")),
    ]
    return _result(raw, F.coalesce(named.cast("string"), parsed.cast("string"), raw), issues)


def boolean(raw: Column) -> Column:
    word = F.lower(F.trim(raw))
    value = F.when(word.isin("yes", "true", "1"), "true").when(word.isin("no", "false", "0"), "false")
    issues = [
        F.when(value.isNotNull(), _issue("warning", F.concat(F.lit('Converted "'), raw, F.lit('" to '), value), True)).otherwise(
            _issue("error", F.concat(F.lit('Cannot convert to boolean: "'), raw, F.lit('"')))
        )
    ]
    return _result(raw, F.coalesce(value, raw), issues)


def date(raw: Column, today: Column) -> Column:
    """Dates more than a year after ``today`` are suspect."""
    from skein.functions.dates import day

    parsed = F.to_date(day(raw))
    issues = [
        F.when(parsed.isNull(), _issue("error", F.concat(F.lit('Cannot parse date: "'), raw, F.lit('"')))).when(
            parsed > F.add_months(today, 12), _issue("warning", F.concat(F.lit("Date is far in the future: "), raw))
        )
    ]
    return _result(raw, raw, issues)


def list_items(items: Column) -> Column:
    """Items cleaned as strings; those that held only markup are dropped."""
    bare = F.transform(items, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), SPACES, " ")))
    return F.filter(bare, lambda x: x != "")


CHECKS = {"price": price, "string": string, "url": url, "image_url": url, "number": number, "boolean": boolean}


def validate(rows: DataFrame, keys: Sequence[str], types: dict[str, str]) -> DataFrame:
    """(keys, field, severity, message, fixed): one row per issue of the declared fields, in one pass over the rows."""

    def issues(name: str, kind: str) -> Column:
        found = CHECKS[kind](F.col(name).cast("string"))["issues"]
        return F.transform(found, lambda i: F.struct(F.lit(name).alias("field"), i["severity"].alias("severity"), i["message"].alias("message"), i["fixed"].alias("fixed")))

    joined = reduce(F.concat, [issues(name, kind) for name, kind in types.items()])
    return rows.select(*keys, F.explode(joined).alias("i")).select(*keys, "i.*")


def cleaned(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    return rows.withColumns({f: CHECKS[kind](F.col(f).cast("string"))["value"] for f, kind in types.items()})
