"""Product names without their variants, amounts as shown, and the concepts that field names and paths stand for."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACES

# Currencies as shown beside an amount, and colour words that a name may end in.
CURRENCY_CODES = r"US\$|AU\$|CA\$|NZ\$|HK\$|S\$|R\$|USD|EUR|GBP|JPY|CNY|INR|AUD|CAD|NZD|CHF|SEK|NOK|DKK|PLN|CZK|HUF|MYR|SGD|HKD|AED|SAR|ZAR|BRL|MXN|TRY|RM"
CURRENCY_NAMES = r"Rs\.?|kr|zł|Kč|Ft|lei"
#: A symbol, or a code that no letter touches, except a capitals code right behind a lower-case letter.
CURRENCY = rf"(?:[$€£¥₹₩₽₺₪฿₫₱]|(?:(?<![A-Za-z])(?:{CURRENCY_CODES}|{CURRENCY_NAMES})|(?<=[a-z])(?:{CURRENCY_CODES}))(?![A-Za-z]))"
AMOUNT = r"(?:\d{1,3}(?:[.,\s\u00a0\u202f']\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?)"
COLOURS = [
    "black", "white", "grey", "gray", "blue", "navy", "red", "green", "yellow", "orange", "pink", "purple", "brown", "beige", "cream", "ivory",
    "silver", "gold", "tan", "khaki", "olive", "teal", "burgundy", "maroon", "charcoal", "lilac", "mint", "multicolour", "multicolor", "natural",
    "light", "dark", "pale", "deep", "bright",
]

# What a product's name may carry beside itself: an option label, a closing bracket, what follows the first
# separator, and closing marks.
OPTION_LABEL = r"^option\s*:\s*"
CLOSING_BRACKET = r"\s*\([^)]*\)$"
AFTER_SEPARATOR = r"^(.{3,}?)(?:\s[-–—|/]\s|,\s).*$"
CLOSING_MARKS = r"[\s,;:.\-–—|/]+$"


def base_name(name: Column) -> Column:
    """A product's name without what tells its colourways apart: prices, case, a closing bracket, whatever follows the
    first spaced dash, bar, slash or comma, and closing colour words."""
    plain = F.lower(F.regexp_replace(name, rf"{CURRENCY}\s?{AMOUNT}|{AMOUNT}\s?{CURRENCY}", " "))
    tidy = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(plain, SPACES, " ")), OPTION_LABEL, ""), CLOSING_BRACKET, "")
    cut = F.regexp_replace(tidy, AFTER_SEPARATOR, "$1")
    coloured = F.regexp_replace(cut, rf"(?:\s+[^\p{{L}}\s]*(?:{'|'.join(COLOURS)})[^\p{{L}}\s]*)+$", "")
    return F.regexp_replace(coloured, CLOSING_MARKS, "")


def name_words(name: Column) -> Column:
    words = F.transform(F.split(base_name(name), r"[\s,;:|/]+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}-]", ""))
    return F.filter(words, lambda w: w != "")


def same_product(a: Column, b: Column) -> Column:
    """Two card names are one product if one's words begin the other's; names without words equal only each other."""
    return same_words(name_words(a), name_words(b))


def same_words(x: Column, y: Column) -> Column:
    length = F.least(F.size(x), F.size(y))
    return F.when(length == 0, F.size(x) == F.size(y)).otherwise(F.slice(x, 1, F.greatest(length, F.lit(1))) == F.slice(y, 1, F.greatest(length, F.lit(1))))


def amount_of(shown: Column) -> Column:
    """A shown price as a number: one or two digits behind the last separator are its fraction."""
    digits = F.regexp_replace(F.regexp_extract(shown, r"\d[\d.,\s  ']*", 0), r"[\s  ']+$", "")
    fraction = F.regexp_extract(digits, r"[.,](\d{1,2})$", 1)
    whole = F.regexp_replace(F.when(fraction != "", F.regexp_replace(digits, r"[.,]\d{1,2}$", "")).otherwise(digits), r"\D", "")
    return F.when(digits != "", F.concat(whole, F.lit("."), F.when(fraction != "", fraction).otherwise("0")).try_cast("double"))


# What in a field's name stands for which concept, in order; and the path ends that carry a concept.
CONCEPT_NAMES = [
    ("price", r"\bprice\b|\bcost\b|\bmsrp\b|\brrp\b"),
    ("product_name", r"^(product[_ ]?)?name$|^title$|\bproduct[_ ]?title\b"),
    ("description", r"\bdescription\b|\bsummary\b"),
    ("image_url", r"\bimage\b|\bphoto\b|\bpicture\b"),
    ("brand", r"\bbrand\b|\bmanufacturer\b"),
    ("sku", r"\bsku\b|\bitem[_ ]?(number|no|id)\b|\bmodel[_ ]?(number|no)\b|\bmpn\b"),
    ("availability", r"\bavailab|\bin[_ ]?stock\b|\bstock\b"),
    ("rating", r"\brating\b|\bstars?\b"),
    ("review_count", r"\breview[_ ]?count\b|\breviews\b"),
    ("currency", r"\bcurrency\b"),
]
CONCEPT_PATHS = {
    "product_name": ["name", "og:title", "title", "productName", "product_name", "headline"],
    "price": ["offers.price", "price", "product:price:amount", "currentPrice", "current_price", "salePrice", "sale_price"],
    "description": ["description", "og:description", "productDescription", "product_description"],
    "image_url": ["image", "images", "og:image", "image.url", "thumbnailUrl", "primary_image_url"],
    "brand": ["brand.name", "brand", "manufacturer", "manufacturer.name", "vendor", "brandName", "brand_name", "product:brand", "og:brand", "seller.name", "og:site_name"],
    "sku": ["sku", "productID", "mpn", "gtin", "gtin13", "code", "item_id", "product_id"],
    "rating": ["aggregateRating.ratingValue", "ratingValue", "rating"],
    "review_count": ["aggregateRating.reviewCount", "reviewCount", "review_count", "ratingCount"],
    "currency": ["offers.priceCurrency", "priceCurrency", "product:price:currency", "currency", "currencyCode", "currency_code", "currencySymbol", "currency_symbol", "currencyPrefix"],
    "availability": [
        "offers.availability", "availability", "inStock", "in_stock", "isAvailable", "is_available", "stock", "stockStatus", "stock_status", "available", "buyable",
        "purchasable", "isInStock", "is_in_stock", "availableForSale", "isBuyable", "orderable", "product:availability", "og:availability",
    ],
}


def concept_of(name: Column, kind: Column) -> Column:
    """The concept of a field by its name, else by its type, else the name itself as a key."""
    words = F.trim(F.regexp_replace(F.lower(name), "[_-]+", " "))
    key = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    by_name = [F.when(words.rlike(pattern), concept) for concept, pattern in CONCEPT_NAMES]
    by_type = F.when(kind == "money", "price").when(kind == "image", "image_url")
    return F.coalesce(*by_name, by_type, F.nullif(key, F.lit("")), F.lit("field"))


def _bare(path: Column) -> Column:
    return F.lower(F.regexp_replace(path, r"\[\d+\]", ""))


def fits_concept(concept: str, path: Column) -> Column:
    """The path ends in one of the concept's path ends, at a step (``.`` or ``:``)."""
    tails = [t.lower() for t in CONCEPT_PATHS.get(concept, [])]
    bare = _bare(path)
    tests = [(bare == t) | bare.endswith(f".{t}") | bare.endswith(f":{t}") for t in tails]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def concept_rank(concept: str, path: Column) -> Column:
    """Place of the path's last step among the concept's path ends; unknown steps come after all."""
    tails = [t.lower() for t in CONCEPT_PATHS.get(concept, [])]
    step = F.element_at(F.split(_bare(path), "[.:]"), -1)
    at = F.array_position(F.array(*map(F.lit, tails)).cast("array<string>"), step)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(tails)))


#: Types whose values a page does not print as they are: never checked.
UNSHOWN_TYPES = ("url", "image", "boolean", "date", "text_list")


def shown_on_page(kind: str, source: Column, value: Column, page_text: Column, prefix: int = 80, words: Sequence[str] = ()) -> Column:
    """True, false, or null for not checked: types that pages do not print, no value. Values read from the page's own
    elements are shown; numbers must stand in the text in some rendering, a zero next to one of the field's own
    ``words``, texts by their first ``prefix`` characters."""
    from .html import shown_key
    from .numbers import number_shown, once, parse_number, zero_shown

    if kind in UNSHOWN_TYPES:
        return F.lit(None).cast("boolean")
    text = shown_key(page_text)
    if kind in ("number", "money"):
        told = once(parse_number(value, money=kind == "money"), lambda v: F.when(v == 0, zero_shown(text, words)).otherwise(number_shown(v, text)))
        found = F.coalesce(told, F.lit(False))
    else:
        key = shown_key(value)
        found = F.when(key != "", F.contains(text, F.substring(key, 1, prefix)))
    return F.when(source == "xpath", True).when(value.isNotNull() & (value != ""), found)
