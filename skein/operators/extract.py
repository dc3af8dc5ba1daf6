"""Extraction: leaves to fields by names, tiers of candidates, certified paths, and the store of paths that worked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.emptiness import is_filled
from skein.functions.urls import brand

from .relational import small

# Names under which pages give each field, in order of preference.
FIELD_ALIASES = {
    "product_name": ["name", "title", "productName", "product_name", "og:title", "headline", "item_name", "product_title"],
    "title": ["name", "title", "headline", "og:title", "item_name"],
    "price": ["price", "currentPrice", "current_price", "salePrice", "sale_price", "offers.price", "product:price:amount", "formatted_current_price", "current_retail", "min_price"],
    "description": ["description", "og:description", "productDescription", "product_description", "soft_bullets", "long_description"],
    "brand": ["brand", "brand.name", "manufacturer", "brand_name", "vendorName"],
    "image_url": ["image", "og:image", "thumbnailUrl", "thumbnail", "primary_image_url", "base_url", "hero_image"],
    "rating": ["aggregateRating.ratingValue", "ratingValue", "rating", "average_overall_rating", "overall_rating", "stars"],
    "review_count": ["aggregateRating.reviewCount", "reviewCount", "review_count", "ratingCount", "total_review_count", "num_reviews"],
    "availability": ["offers.availability", "availability", "availability_status", "in_stock", "is_available"],
    "sku": ["sku", "productID", "mpn", "gtin", "gtin13", "tcin", "item_id", "product_id", "asin"],
    "url": ["url", "og:url", "canonical_url", "product_url"],
    "category": ["category", "product:category", "category_name", "department", "breadcrumb"],
    "currency": ["offers.priceCurrency", "priceCurrency", "product:price:currency", "currency_code"],
}
#: Pools of leaves in the order they are asked.
POOLS = {"api": 0, "json-ld": 1, "meta": 2}


def alias_table(spark, fields: Sequence[str], aliases: dict[str, list[str]] = FIELD_ALIASES) -> DataFrame:
    """(field, alias, alias_rank): the field's own name has rank -1. Made of literals, whose size the optimizer knows: rows
    handed in from Python count as endless to it, so that the other side of a join is broadcast in their place."""
    rows = [(f, name, n - 1) for f in fields for n, name in enumerate([f, *aliases.get(f, [])])]
    listed = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(name).alias("alias"), F.lit(rank).alias("alias_rank")) for f, name, rank in rows])
    return spark.range(1).select(F.inline(listed))


def mechanical(leaves: DataFrame, keys: Sequence[str], names: DataFrame) -> DataFrame:
    """One value per page and field from leaves (keys, pool, path, pos, value): own name, then an alias as the whole
    path, then an alias as its end (fewest steps), then the own name as its end. Pools in their order.

    A path's ends are exploded (at most as many as it has steps), so the match is an equality join on names.
    """
    parts = F.split("path", r"\.")
    ends = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("cut"), F.array_join(F.slice(parts, i + 1, F.size(parts)), ".").alias("end")))
    depth = F.size(parts) + F.size(F.split("path", r"\[")) - 1
    ended = leaves.where(is_filled(F.col("value"))).select(*keys, "pool", "path", "pos", "value", depth.alias("depth"), F.explode(ends).alias("e"))
    found = ended.join(small(names), F.col("e.end") == F.col("alias"))
    own = F.col("alias_rank") < 0
    rule = F.when(F.col("e.cut") == 0, F.when(own, 0).otherwise(1)).otherwise(F.when(own, 3).otherwise(2))
    # whole-path matches go by alias order, path ends by depth
    order = F.struct(
        F.element_at(F.create_map(*[F.lit(x) for kv in POOLS.items() for x in kv]), F.col("pool")).alias("pool_rank"),
        rule.alias("rule"),
        F.when(rule == 1, F.col("alias_rank")).otherwise(F.col("depth")).alias("near"),
        "alias_rank",
        "pos",
        "path",
    )
    best = F.min_by(F.struct("value", "path", F.col("pool").alias("source")), order)
    return found.groupBy(*keys, "field").agg(best.alias("b")).select(*keys, "field", "b.*")


def first_tier(candidates: DataFrame, keys: Sequence[str], valid: Column) -> DataFrame:
    """Chain of tiers: per page and field the valid candidate of the lowest tier, then the first in its tier (columns
    tier, place). Rejected candidates of stored paths are what ``rejected`` gives."""
    columns = [c for c in candidates.columns if c not in (*keys, "field")]
    best = F.min_by(F.struct(*columns), F.struct("tier", "place"))
    return candidates.where(valid).groupBy(*keys, "field").agg(best.alias("b")).select(*keys, "field", "b.*")


def rejected(candidates: DataFrame, valid: Column) -> DataFrame:
    """Stored paths whose value was refused: each is charged a miss."""
    return candidates.where(~F.coalesce(valid, F.lit(False)) & F.col("stored"))


def certified(readings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Readings of certified paths (keys, field, path_rank, path, source, value) to one value per field: the first
    filled one. Adds tried (paths read up to and with the hit) and hit."""
    filled = is_filled(F.col("value"))
    best = F.min_by(F.when(filled, F.struct("value", "path", "source")), F.when(filled, F.col("path_rank")))
    grouped = readings.groupBy(*keys, "field").agg(best.alias("b"), F.min(F.when(filled, F.col("path_rank"))).alias("hit_rank"), F.count("*").alias("paths"))
    return grouped.select(*keys, "field", "b.value", "b.path", "b.source", F.coalesce("hit_rank", "paths").alias("tried"), F.col("hit_rank").isNotNull().alias("hit"))


def path_outcomes(readings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hits and misses per path: the paths before a page's hit missed, those after it were not asked."""
    first = F.min(F.when(is_filled(F.col("value")), F.col("path_rank"))).over(W.partitionBy(*keys, "field"))
    asked = readings.withColumn("_first", first).where(F.col("_first").isNull() | (F.col("path_rank") <= F.col("_first")))
    hit = F.col("path_rank").eqNullSafe(F.col("_first"))
    return asked.groupBy("field", "source", "path").agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))


def merge_observations(paths: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored paths after observations (keys, source, path, seq, hit, value, at): hits and misses add up, confidence
    moves by 0.02 up or 0.05 down within 0 and 1 in the order of ``seq``, the last seen value stays. Unknown paths are
    new with the confidence of their first observation.

    The clamp makes the order matter: a path's observations are folded as one sorted array of (seq, hit).
    """
    same = [*keys, "source", "path"]
    step = F.struct("seq", "hit")
    seen = observed.groupBy(*same).agg(
        F.array_sort(F.collect_list(step)).alias("steps"),
        F.count_if("hit").alias("new_hits"),
        F.count_if(~F.col("hit")).alias("new_misses"),
        F.max_by(F.when(F.col("hit"), F.col("value")), F.when(F.col("hit"), F.col("seq"))).alias("seen_value"),
        F.max("at").alias("seen_at"),
        F.min_by("confidence", "seq").alias("first_confidence"),
    )
    joined = paths.join(seen, same, "full")
    known = F.col("confidence").isNotNull()
    steps = F.coalesce("steps", F.array().cast("array<struct<seq: long, hit: boolean>>"))
    todo = F.when(known, steps).otherwise(F.slice(steps, 2, F.greatest(F.size(steps), F.lit(1))))
    moved = F.aggregate(
        todo,
        F.coalesce("confidence", "first_confidence").cast("double"),
        lambda c, s: F.when(s["hit"], F.least(F.lit(1.0), c + 0.02)).otherwise(F.greatest(F.lit(0.0), c - 0.05)),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        *same,
        moved.alias("confidence"),
        (zero("hits") + zero("new_hits")).alias("hits"),
        (zero("misses") + zero("new_misses")).alias("misses"),
        F.coalesce("seen_value", "last_value").alias("last_value"),
        F.coalesce("seen_at", "last_used_at").alias("last_used_at"),
        F.coalesce("pinned", F.lit(False)).alias("pinned"),
    )


def lookup_cache(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Stored row per wanted (domain, page_type): the exact one, else of the same brand and type the one with the most
    successful runs (ties: domain in byte order)."""
    exact = cache.select("domain", "page_type", F.struct(*cache.columns).alias("_exact"))
    order = F.struct("successful_runs", F.col("domain"))
    by_brand = cache.groupBy(brand(F.col("domain")).alias("_brand"), "page_type").agg(F.max_by(F.struct(*cache.columns), order).alias("_kin"))
    joined = wanted.withColumn("_brand", brand(F.col("domain"))).join(exact, ["domain", "page_type"], "left").join(by_brand, ["_brand", "page_type"], "left")
    return joined.select("domain", "page_type", F.coalesce("_exact", "_kin").alias("found"), F.col("_exact").isNotNull().alias("is_exact"))


def agreement_confidence(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per field the best-ranked value and the share of candidates that agree with it; one candidate keeps its path's
    confidence."""
    per_value = candidates.groupBy(*keys, "field", F.lower(F.trim("value")).alias("_v")).agg(
        F.count("*").alias("n"), F.min(F.struct("rank", "value", "confidence")).alias("best")
    )
    best = F.min_by(F.struct("best", "n"), "best.rank")
    grouped = per_value.groupBy(*keys, "field").agg(best.alias("b"), F.sum("n").alias("all"))
    confidence = F.when(F.col("all") == 1, F.col("b.best.confidence")).otherwise(F.col("b.n") / F.col("all"))
    return grouped.select(*keys, "field", F.col("b.best.value").alias("value"), confidence.alias("confidence"))


def resolved_fields(candidates: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every wanted field (keys, field) with the value its stored paths agree on, its confidence, and whether it failed: no
    path gave a filled value."""
    found = agreement_confidence(candidates.where(is_filled(F.col("value"))), keys)
    joined = wanted.select(*keys, "field").distinct().join(found, [*keys, "field"], "left")
    return joined.withColumn("failed", F.col("value").isNull())


def search_candidates(leaves: DataFrame, keys: Sequence[str], expected: DataFrame, equal: Column) -> DataFrame:
    """Leaves that show a page's expected value (keys, field, expected): the page's rows meet by key, then compare."""
    return leaves.join(expected, list(keys)).where(equal)


def suggestions(leaves: DataFrame, keys: Sequence[str], names: DataFrame) -> DataFrame:
    """The shallowest leaf whose last step is a usual name of the field."""
    return mechanical(leaves, keys, names)


def describes_same_page(entity_type: Column, entity_ids: Column, page_ids: Column) -> Column:
    """False only on a positive mismatch: an entity of a product type, identifiers on both sides, none in common."""
    typed = F.lower(entity_type).isin("product", "productgroup", "offer", "book", "vehicle", "event", "course")
    both = (F.size(entity_ids) > 0) & (F.size(page_ids) > 0)
    return ~(F.coalesce(typed, F.lit(False)) & both & ~F.arrays_overlap(entity_ids, page_ids))


def identifiers(text: Column, least: int = 6) -> Column:
    """Distinct lower-case words of ``least`` characters or more that hold a digit."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: (F.length(w) >= least) & w.rlike(r"\d")))


def catalogue(entries: DataFrame, keys: Sequence[str], most: int = 8, longest: int = 160) -> DataFrame:
    """Candidates of a concept (label, path, sample_value, displayed, place): malformed ones go, a label counts once, at
    most ``most`` stay, one is displayed, samples are cut to ``longest`` characters."""
    good = entries.where(is_filled(F.col("label")) & is_filled(F.col("path")))
    once = good.withColumn("_n", F.row_number().over(W.partitionBy(*keys, "label").orderBy("place"))).where("_n = 1")
    capped = once.withColumn("_p", F.row_number().over(W.partitionBy(*keys).orderBy("place"))).where(F.col("_p") <= most)
    shown = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("displayed").desc(), "place")) == 1
    sample = F.when(F.length("sample_value") > longest, F.concat(F.substring("sample_value", 1, longest), F.lit("…"))).otherwise(F.col("sample_value"))
    return capped.withColumn("displayed", shown).withColumn("sample_value", sample).drop("_n", "_p")
