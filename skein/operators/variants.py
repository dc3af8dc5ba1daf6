"""Variant rows: a product row exploded by its entries, keys, summaries, and the export shapes that group them again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.emptiness import is_empty, is_filled
from skein.functions.urls import without_fragment


def variant_key(sku: Column | None, gtin: Column | None, own_url: Column | None, axes: Sequence[Column]) -> Column:
    """The SKU, else the GTIN, else the page's own address, else the axis values joined by a middle dot."""
    choices = [F.when(is_filled(c), c.cast("string")) for c in (sku, gtin) if c is not None]
    if own_url is not None:
        choices.append(F.when(is_filled(own_url), without_fragment(own_url)))
    joined = F.concat_ws(" · ", *[F.coalesce(a.cast("string"), F.lit("")) for a in axes])
    return F.coalesce(*choices, joined)


def group_key(urls: Column) -> Column:
    """Of a product's addresses the smallest without fragment: the same whichever member page comes first."""
    return F.array_min(F.transform(urls, without_fragment))


def explode_variants(
    products: DataFrame,
    entries: str,
    url: str,
    entry_fields: dict[str, str],
    axes: dict[str, str],
    from_product: Sequence[str] = (),
    sku: str | None = None,
    gtin: str | None = None,
) -> DataFrame:
    """One row per entry (an array of structs or maps), or the product row itself without entries.

    ``entry_fields`` and ``axes`` map column to entry key; fields ``from_product`` keep the product's value. Adds
    _product_key, _variant_pos, _variant_key (null without entries) and _variant_partial: some entry value is empty.
    """
    read = {**entry_fields, **axes}
    exploded = products.select("*", F.posexplode_outer(entries).alias("_variant_pos", "_entry")).drop(entries)
    has = F.col("_entry").isNotNull()
    values = {c: F.col("_entry")[key].cast("string") for c, key in read.items() if c not in from_product}
    partial = has & F.coalesce(F.greatest(*[is_empty(v).cast("int") for v in values.values()], F.lit(0)) == 1, F.lit(False))
    out = exploded.withColumn("_variant_partial", partial)
    for c, v in values.items():
        own = F.col(c).cast("string") if c in products.columns else F.lit(None).cast("string")
        out = out.withColumn(c, F.when(has, F.when(is_filled(v), v)).otherwise(own))
    key = variant_key(F.col(sku) if sku else None, F.col(gtin) if gtin else None, None, [F.col(a) for a in axes])
    return out.withColumn("_variant_key", F.when(has, key)).withColumn("_product_key", without_fragment(F.col(url))).drop("_entry")


def variant_summary(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """variants, products, without_variants and partial per group: products are folded first, then counted."""
    keyed = is_filled(F.col("_variant_key"))
    per_product = rows.groupBy(*by, "_product_key").agg(
        F.count_if(keyed).alias("n"), F.max(keyed).alias("has_variant"), F.max(F.coalesce("_variant_partial", F.lit(False))).alias("is_partial")
    )
    known = F.col("_product_key").isNotNull()
    return per_product.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("variants"),
        F.count_if(known).alias("products"),
        F.count_if(known & ~F.col("has_variant")).alias("without_variants"),
        F.count_if(known & F.col("is_partial")).alias("partial"),
    )


def nested_rows(rows: DataFrame, key: str, order: Sequence[str], product_fields: Sequence[str], member_fields: Sequence[str], separator: str = "; ") -> DataFrame:
    """One row per product: its first row's product fields, and each member field's values joined in row order. Empty
    values join as ''. A product's members are gathered in one task, as its row needs them all."""
    members = F.array_sort(F.collect_list(F.struct(*order, *[F.coalesce(F.col(m).cast("string"), F.lit("")).alias(f"_m_{m}") for m in member_fields])))
    first = F.min_by(F.struct(*[F.col(p) for p in product_fields]), F.struct(*order)).alias("_first")
    grouped = rows.groupBy(key).agg(first, members.alias("_members"), F.min(F.struct(*order)).alias("_order"))

    def joined(name: str) -> Column:
        return F.array_join(F.transform("_members", lambda x: x[f"_m_{name}"]), separator).alias(name)

    return grouped.select(key, "_first.*", *[joined(m) for m in member_fields], F.size("_members").alias("members"))


def variant_documents(rows: DataFrame, key: str, order: Sequence[str], product_fields: Sequence[str], member_fields: Sequence[str]) -> DataFrame:
    """The nested JSON form: product fields and ``variants``; a product without variants carries the member fields
    itself and has an empty array."""
    member = F.struct(*order, F.col("_variant_key"), *[F.col(m) for m in member_fields])
    first = F.min_by(F.struct(*product_fields, *[F.col(m).alias(f"_own_{m}") for m in member_fields]), F.struct(*order))
    grouped = rows.groupBy(key).agg(first.alias("_first"), F.array_sort(F.collect_list(member)).alias("_members"))
    real = F.filter("_members", lambda m: is_filled(m["_variant_key"]))
    shaped = F.transform(real, lambda m: F.struct(*[m[f].alias(f) for f in member_fields], m["_variant_key"].alias("variant_key")))
    own = [F.when(F.size(real) == 0, F.col(f"_first._own_{m}")).alias(m) for m in member_fields]
    return grouped.select(key, *[F.col(f"_first.{p}").alias(p) for p in product_fields], *own, shaped.alias("variants"))
