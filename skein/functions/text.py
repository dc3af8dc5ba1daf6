"""Text forms: comparison form, stored form, labels, words."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Word sets of the boolean type.
TRUE_WORDS = ["true", "yes", "y", "1", "in stock", "instock", "available", "in-stock", "https://schema.org/instock", "http://schema.org/instock"]
FALSE_WORDS = ["false", "no", "n", "0", "out of stock", "outofstock", "unavailable", "sold out", "https://schema.org/outofstock", "http://schema.org/outofstock"]


#: White space of any script, spelt out: the engine's own Unicode classes are many times slower.
SPACES = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def collapse(text: Column) -> Column:
    """White-space runs (no-break and other Unicode spaces included) become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def unicode_form(text: Column, form: str) -> Column:
    """Unicode normalisation. Spark has no built-in, so batches visit Python; prefer ``collapse`` on data known
    to be in the wanted form."""

    @F.pandas_udf("string")
    def normalise(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize(form, v))

    return normalise(text)


def compare_text(text: Column, fold: bool = True) -> Column:
    """Comparison form: compatibility-folded, collapsed, '' as null."""
    shaped = collapse(unicode_form(text, "NFKC") if fold else text)
    return F.when(shaped != "", shaped)


def stored_text(text: Column, fold: bool = True) -> Column:
    """The page's own characters (canonical composition only), collapsed."""
    return collapse(unicode_form(text, "NFC") if fold else text)


def boolean_word(text: Column) -> Column:
    """'true' or 'false' for the known words, null for any other."""
    word = F.lower(collapse(text))
    return F.when(word.isin(TRUE_WORDS), "true").when(word.isin(FALSE_WORDS), "false")


def list_items(text: Column) -> Column:
    """Items of a text list: split at line breaks, commas and semicolons, lower-case, distinct, sorted; null if none."""
    items = F.transform(F.split(text, r"[\n,;]"), lambda x: F.lower(collapse(x)))
    kept = F.array_sort(F.array_distinct(F.filter(items, lambda x: x != "")))
    return F.when(F.size(kept) > 0, kept)


#: Joins the items of a normalised list; never part of page text.
LIST_SEPARATOR = "\x1f"


def list_key(text: Column) -> Column:
    return F.array_join(list_items(text), LIST_SEPARATOR)


def after_label(text: Column) -> Column:
    """The text behind a leading ``Label:`` of at most 30 characters with a letter and no digit; null without one."""
    pattern = r"^([^\d:\n]{1,30}): *(\S.*)$"
    flat = collapse(text)
    label = F.regexp_extract(flat, pattern, 1)
    return F.when(label.rlike(r"\p{L}"), F.regexp_extract(flat, pattern, 2))


def label_form(text: Column) -> Column:
    """Option labels for matching: lower case, quotes and primes dropped, × as x, sizes joined (6 x 9), leading zeros
    of numbers dropped, anything but letters and digits as one blank."""
    plain = F.regexp_replace(F.lower(text), "[‘’“”'\"`′″]", "")
    joined = F.regexp_replace(F.replace(plain, F.lit("×"), F.lit("x")), r"(\d)\s*([x/])\s*(?=\d)", "$1$2")
    return F.trim(F.regexp_replace(F.regexp_replace(joined, r"(^|[^\d.])0+(?=\d)", "$1"), r"[^a-z0-9]+", " "))


def labels_agree(named: Column, shown: Column) -> Column:
    """Every word of the named value is among the words of the shown one."""
    return F.size(F.array_except(F.split(label_form(named), " "), F.split(label_form(shown), " "))) == 0


def snake(name: Column) -> Column:
    """Field key of a free-text name."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def slug(name: Column, limit: int = 60) -> Column:
    made = F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, limit)
    return F.when(made == "", F.lit("export")).otherwise(made)


def words(text: Column, least: int = 1) -> Column:
    """Distinct lower-case words of at least ``least`` letters or digits, in first-seen order."""
    found = F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: F.length(w) >= least)
    return F.array_distinct(found)


# The fields and sources whose values must be seen on the page.
CORROBORATED_FIELDS = ["product_name", "title", "name", "brand", "manufacturer"]
CORROBORATED_SOURCES = ["api", "api-ai"]


def prepared(page_text: Column) -> Column:
    """Page text as words are looked for in it."""
    return F.lower(collapse(page_text))


def long_words(value: Column, least: int = 3) -> Column:
    """The value's words of ``least`` characters or more, repeats included, as they are looked for in prepared text."""
    return F.filter(F.split(prepared(value), " "), lambda w: F.length(w) >= least)


def share_of(tokens: Column, seen: Column) -> Column:
    """Share of ``tokens`` that occur in the prepared text, as substrings; null without tokens."""
    hits = F.size(F.filter(tokens, lambda w: F.contains(seen, w)))
    return F.when(F.size(tokens) > 0, hits / F.size(tokens))


def share_in(value: Column, seen: Column, least: int = 3) -> Column:
    """``share_of`` the value's long words; null for a value without such words."""
    return share_of(long_words(value, least), seen)


def token_share(value: Column, page_text: Column, least: int = 3) -> Column:
    """``share_in`` of a page's text. The text is an element of an array, so that it is prepared once, not once a word."""
    return F.transform(F.array(prepared(page_text)), lambda seen: share_in(value, seen, least))[0]


def corroborated(value: Column, page_text: Column, source: Column, field: Column, share: float = 0.6) -> Column:
    """Name-like values from recorded responses stand only if the page's text shows ``share`` of their words. Other
    values, empty pages and values without long words stand as they are."""
    applies = source.isin(CORROBORATED_SOURCES) & field.isin(CORROBORATED_FIELDS) & (F.coalesce(page_text, F.lit("")) != "")
    return ~applies | F.coalesce(token_share(value, page_text) >= share, F.lit(True))
