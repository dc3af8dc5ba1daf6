"""Pages and their variants: which one an address names, whether the page shows another, lists of variants certified
against what was counted on proof pages, and the entry of a list that is the page's own."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import urls as U

# Parameters that name a variant by its identifier, and what an identifier looks like.
ID_KEY = r"(?i)^(variant|variant_?id|sku)$"
ID_VALUE = r"^(?:gid://\S+/)?(\d{6,})$"
OTHER_ID = r"^gid://\S+/([^/\s]+)$"


def identifier(value: Column) -> Column:
    """The identifier in a value: a long number, plain or behind a resource prefix, or the end of such a prefix."""
    v = F.trim(value)
    found = [F.nullif(F.regexp_extract(v, pattern, 1), F.lit("")) for pattern in (ID_VALUE, OTHER_ID)]
    return F.coalesce(*found)


def address_variant(url: Column) -> Column:
    """struct<ids, pairs, labels> of what an address names: identifiers stand under variant keys only, all other values are
    labels."""
    entries = F.map_entries(U.variant_pairs(url))
    own = lambda e: F.when(e["key"].rlike(ID_KEY), F.coalesce(identifier(e["value"]), F.when(e["value"].rlike(r"^\d+$"), e["value"])))
    labels = F.transform(F.filter(entries, lambda e: own(e).isNull()), lambda e: e["value"])
    return F.struct(F.array_compact(F.transform(entries, own)).alias("ids"), entries.alias("pairs"), labels.alias("labels"))


def wrong_variant(url: Column, ids: Column, pairs: Column, labels: Column) -> Column:
    """The pairs that an address names, as text, when the page shows another variant: of some kind that both tell nothing
    agrees, and no other kind does. Kinds are identifiers, and values under one name (``pairs`` maps lower-case names to
    what is selected); labels alone never decide. Null if nothing speaks against the page."""
    named = address_variant(url)
    told = lambda a: F.size(a) > 0
    by_id = F.arrays_overlap(named["ids"], ids) | F.exists(named["ids"], lambda i: F.exists(labels, lambda x: T.labels_agree(i, x)))
    key = lambda p: F.lower(F.trim(p["key"]))
    comparable = F.filter(named["pairs"], lambda p: ~p["key"].rlike(ID_KEY) & F.map_contains_key(pairs, key(p)))
    by_pair = F.exists(comparable, lambda p: T.labels_agree(p["value"], F.element_at(pairs, key(p))))
    ids_told, pairs_told = told(named["ids"]) & told(ids), told(comparable)
    agrees = (ids_told & F.coalesce(by_id, F.lit(False))) | (pairs_told & F.coalesce(by_pair, F.lit(False)))
    text = F.array_join(F.transform(named["pairs"], lambda p: F.concat(p["key"], F.lit("="), p["value"])), "&")
    return F.when((ids_told | pairs_told) & ~agrees, text)


def page_twins(leaves: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Leaves with a twin for each one in the page's own entry of a list: ``rows[3].price`` is also ``rows[page].price``.
    ``chosen`` has (keys, list_path, item), one row a list. The leaves are read once: each goes on beside its twins."""
    lists = chosen.groupBy(*keys).agg(F.collect_list(F.struct("list_path", "item")).alias("_lists"))
    stem = lambda c: F.concat(c["list_path"], F.lit("["), c["item"].cast("string"), F.lit("]"))
    rest = lambda c: F.substr("path", F.length(stem(c)) + 1)
    inside = F.filter("_lists", lambda c: F.col("path").startswith(stem(c)) & F.left(rest(c), F.lit(1)).isin("", ".", "["))
    twins = F.transform(inside, lambda c: F.concat(c["list_path"], F.lit("[page]"), rest(c)))
    paths = F.concat(F.array("path"), F.coalesce(twins, F.array().cast("array<string>")))
    told = leaves.join(lists, list(keys), "left").withColumn("_path", F.explode(paths))
    return told.select(*[F.col("_path").alias(c) if c == "path" else c for c in leaves.columns])


def on_page(path: Column, list_path: Column, item: Column) -> Column:
    """A path with a ``[page]`` step as the path of the page's own entry; null where the step stands on another list or
    the page has no entry. Paths without such a step stay."""
    mark = F.concat(list_path, F.lit("[page]"))
    led = F.concat(list_path, F.lit("["), item.cast("string"), F.lit("]"), F.substr(path, F.length(mark) + 1))
    return F.when(~F.contains(path, F.lit("[page]")), path).when(path.startswith(mark), led)


def certify_lists(counted: DataFrame, lists: DataFrame, by: Sequence[str], noun: str = "variants") -> tuple[DataFrame, DataFrame]:
    """Which list holds the variants of a set of proof pages, and what is wrong on each.

    ``counted`` has (by, url, n, count, source, path, captured): what somebody counted on page number ``n`` and in which
    list it was seen (null if none); ``lists`` has (by, url, source, path, entries). The list that fits most captured
    pages is chosen, of equals the one seen on the earlier page; a page without variants fits if the list is empty there.

    Returns (by, source, path, fits) and per page (by, url, status, message): ok, none, not_captured, failed."""
    seen = counted.where((F.col("count") > 0) & F.col("source").isNotNull()).groupBy(*by, "source", "path").agg(F.min("n").alias("first"))
    pages = counted.select(*by, "url", "n", "count", "captured")
    tried = seen.join(pages.where("captured"), list(by)).join(lists.select(*by, "url", "source", "path", "entries"), [*by, "url", "source", "path"], "left")
    fits = F.coalesce("entries", F.lit(0)) == F.col("count")
    scored = tried.groupBy(*by, "source", "path").agg(F.count_if(fits).alias("fits"), F.min("first").alias("first"))
    best = F.max_by(F.struct("source", "path", "fits"), F.struct("fits", -F.col("first")))
    chosen = scored.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")
    some = F.max(F.col("count") > 0).over(W.partitionBy(*by))
    read = pages.withColumn("some", some).join(chosen.drop("fits"), list(by), "left").join(lists.select(*by, "url", "source", "path", "entries"), [*by, "url", "source", "path"], "left")
    found, wanted, page = F.coalesce("entries", F.lit(0)), F.col("count"), F.concat(F.lit(" on product "), F.col("n").cast("string"))
    words = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    message = (
        F.when(found == wanted, F.lit(None).cast("string"))
        .when(wanted == 0, words("product ", F.col("n"), " lists ", found, f" {noun} — confirm them"))
        .when(found == 0, F.concat(F.lit(f"found no {noun}"), page))
        .when(found < wanted, F.concat(words("found ", found, " of ", wanted, f" {noun}"), page))
        .otherwise(F.concat(words("found ", found, f" {noun}"), page, words(", expected ", wanted)))
    )
    status = F.when(~F.col("captured"), "not_captured").when(~F.col("some"), "none").when(message.isNotNull(), "failed").when(wanted == 0, "none").otherwise("ok")
    told = F.when(F.col("captured") & F.col("some"), message)
    return chosen, read.select(*by, "url", status.alias("status"), told.alias("message"))


def same_entries(entries: DataFrame, by: Sequence[str], order: str, axes: Sequence[str]) -> DataFrame:
    """Pages on which two entries of a list read the same on all axes: (by, text) with the values of the first such entry (in byte order where places repeat)."""
    keys = [F.coalesce(T.compare_text(F.col(a), fold=False), F.lit("")) for a in axes]
    rows = entries.select(*by, order, *[k.alias(f"_k{n}") for n, k in enumerate(keys)])
    twice = rows.groupBy(*by, *[f"_k{n}" for n in range(len(axes))]).agg(F.count("*").alias("n"), F.min(order).alias("at")).where("n > 1")
    text = reduce(lambda a, b: F.concat(a, F.lit("/"), b), [F.col(f"_k{n}") for n in range(len(axes))])
    return twice.groupBy(*by).agg(F.min_by(text, F.struct(F.col("at"), text)).alias("text"))
