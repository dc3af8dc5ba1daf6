"""Operators over leaf tables of JSON documents: variant lists, entity subtrees, page shapes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import urls as U
from skein.functions.emptiness import is_filled

# Keys that make an entry of a list a variant, and tokens that an entity's keys hold.
VARIANT_KEYS = ["color", "size", "capacity", "finish", "material", "pattern", "quantity", "sku", "mpn", "productid", "price", "offers", "options", "selectedoptions"]
AXES = ["color", "size", "material", "pattern"]
AXIS_KEYS = ["color", "size", "capacity", "finish", "material", "pattern", "quantity"]
NARROW = ["option1", "option2", "option3", "options", "selectedoptions"]
ENTITY_TOKENS = [
    "name", "title", "price", "description", "sku", "image", "brand", "category", "availability", "rating", "review", "color",
    "size", "variant", "option", "product", "weight", "dimension", "model", "ingredient", "material", "currency",
]


def variant_lists(leaves: DataFrame, keys: Sequence[str], least: int = 2, most: int = 3) -> DataFrame:
    """Lists of a page (leaves with source, path) that hold variants: entries with a variant key of their own, at least
    ``least``; linked data before responses, longer first, ``most`` a page. (keys, source, list_path, entries, rank)

    In linked data they are ``hasVariant``, or offers (one by one or of an aggregate) that all have a sku or price. In a
    response two entries or more must have a sku or price and one an axis or options, or two an id and one options."""
    inside = leaves.where(is_filled(F.col("value"))).select(*keys, "source", "path").where(F.col("path").rlike(r"\[\d+\]\."))
    list_path = F.regexp_extract("path", r"^(.*?)\[\d+\](?:\.|$)", 1)
    item = F.regexp_extract("path", r"^.*?\[(\d+)\](?:\.|$)", 1)
    own_key = F.lower(F.regexp_extract("path", r"^.*?\[\d+\]\.([^.\[]+)", 1))
    by_item = inside.select(*keys, "source", list_path.alias("list_path"), item.alias("item"), own_key.alias("key")).groupBy(*keys, "source", "list_path", "item").agg(
        F.max(F.col("key").isin(VARIANT_KEYS) | F.col("key").startswith("gtin")).alias("variant"),
        F.max(F.col("key").isin("sku", "price")).alias("sold"),
        F.max(F.col("key").isin("id", "variant_id")).alias("named"),
        F.max(F.col("key").isin(NARROW)).alias("narrow"),
        F.max(F.col("key").isin([*AXIS_KEYS, *NARROW])).alias("axis"),
    )
    real = F.col("variant")
    lists = by_item.groupBy(*keys, "source", "list_path").agg(
        F.count_if("variant").alias("entries"), F.count_if(real & F.col("sold")).alias("sold"), F.min("sold").alias("all_sold"), F.count_if(real & F.col("named")).alias("named"),
        F.max(real & F.col("narrow")).alias("narrow"), F.max(real & F.col("axis")).alias("axis"),
    )
    linked = F.col("list_path").rlike(r"(^|\.)hasVariant$") | (F.col("list_path").rlike(r"(^|\.)offers$") & F.col("all_sold"))
    recorded = ((F.col("sold") >= 2) & F.col("axis")) | (F.col("narrow") & (F.col("named") >= 2))
    order = W.partitionBy(*keys).orderBy((F.col("source") != "json-ld").cast("int"), F.col("entries").desc(), "list_path")
    good = lists.where((F.col("entries") >= least) & F.when(F.col("source") == "json-ld", linked).otherwise(recorded))
    return good.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select(*keys, "source", "list_path", "entries", "rank")


def product_group_variants(leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Variants of a linked-data ProductGroup, one row an entry: sku (mpn, sku, productID), price, image_url and axes."""
    held = leaves.withColumn("item", F.regexp_extract("path", r"hasVariant\[(\d+)\]\.", 1)).where("item <> ''")
    name = F.regexp_extract("path", r"hasVariant\[\d+\]\.(.*)$", 1)
    pick = lambda *names: F.coalesce(*[F.max(F.when(name == n, F.col("value"))) for n in names])
    number = F.regexp_replace(pick("offers.price"), r"[$,€£¥\s]", "").try_cast("double")
    axes = [pick(a).alias(a) for a in AXES]
    return held.groupBy(*keys, F.col("item").cast("int").alias("item")).agg(pick("mpn", "sku", "productID").alias("sku"), number.alias("price"), pick("image", "image[0]").alias("image_url"), *axes)


def entity_subtree(leaves: DataFrame, keys: Sequence[str], tokens: Sequence[str] = ENTITY_TOKENS, least: int = 2) -> DataFrame:
    """The object of a document whose own keys hold the most distinct tokens, the first in document order of equals;
    one that stands under a ``selected`` key wins if it has at most one token less: (keys, path, score). ``leaves`` come
    from the walk ``ENTITIES``, which has keys without values too. Each leaf tells a key to every object above it, so
    keys that hold objects count. Documents whose objects have less than ``least`` tokens have no row."""
    steps = F.regexp_extract_all("path", F.lit(r"(\.?[^.\[\]]+|\[\d+\])"), F.lit(1))
    is_key = lambda step: ~step.startswith("[")
    word = lambda step: F.lower(F.ltrim(step, F.lit(".")))

    def told(step, i):
        over = F.try_element_at("steps", i)
        chosen = F.when(i > 0, is_key(over) & F.contains(word(over), F.lit("selected")))
        bits = [F.when(F.contains(word(step), F.lit(t)), F.lit(1 << n)).otherwise(F.lit(0)) for n, t in enumerate(tokens)]
        return F.when(is_key(step), F.struct(F.array_join(F.slice("steps", F.lit(1), i), "").alias("path"), i.alias("level"), F.coalesce(chosen, F.lit(False)).alias("chosen"), reduce(lambda a, b: a + b, bits).cast("long").alias("bits")))

    pairs = leaves.select(*keys, "pos", steps.alias("steps")).select(*keys, "pos", F.explode(F.array_compact(F.transform("steps", told))).alias("t")).select(*keys, "pos", "t.*")
    objects = pairs.groupBy(*keys, "path").agg(F.bit_count(F.bit_or("bits")).cast("long").alias("score"), F.min("pos").alias("pos"), F.first("level").alias("level"), F.first("chosen").alias("chosen")).where(F.col("score") >= least)
    first = F.struct("score", -F.col("pos"), -F.col("level"))
    found = F.struct("path", "score")
    best, chosen = F.max_by(found, first), F.max_by(found, F.when(F.col("chosen"), first))
    both = objects.groupBy(*keys).agg(best.alias("best"), chosen.alias("chosen"))
    return both.select(*keys, F.when(F.col("chosen.score") >= F.col("best.score") - 1, F.col("chosen")).otherwise(F.col("best")).alias("b")).select(*keys, "b.*")


def page_shapes(pages: DataFrame, leaves: DataFrame, keys: Sequence[str], url: str) -> DataFrame:
    """What kind of page it is: linked-data types, where offers stand, whether a rating above 0 is there, and the address
    pattern."""
    types = F.array_sort(F.collect_set(F.when(F.col("path").rlike(r"(^|\.|\])@type$"), F.col("value"))))
    offers = F.max(F.when(F.col("path").rlike(r"^(\[\d+\]\.)?offers"), 2).when(F.contains("path", F.lit("hasVariant")) & F.contains("path", F.lit("offers")), 1).otherwise(0))
    rated = F.max(F.col("path").rlike(r"(?i)(ratingValue|\brating)$") & F.coalesce(F.col("value").try_cast("double") > 0, F.lit(False)))
    found = leaves.groupBy(*keys).agg(types.alias("types"), offers.alias("_offers"), rated.alias("rating"))
    placed = F.when(F.col("_offers") == 2, "top-level").when(F.col("_offers") == 1, "in-variants").otherwise("none")
    joined = pages.select(*keys, U.address_pattern(F.col(url)).alias("pattern")).join(found, list(keys), "left")
    return joined.select(*keys, "pattern", F.coalesce("types", F.array().cast("array<string>")).alias("types"), placed.alias("offers"), F.coalesce("rating", F.lit(False)).alias("rating"))


def resolvable(catalogue: DataFrame, leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Catalogue entries whose path leads to a leaf of the page, or that were used before."""
    known = leaves.select(*keys, "path").distinct().withColumn("_leads", F.lit(True))
    joined = catalogue.join(known, [*keys, "path"], "left")
    return joined.where(F.coalesce("_leads", F.lit(False)) | F.coalesce("used", F.lit(False))).drop("_leads")


def string_paths(item: Column) -> Column:
    """Paths to texts in a JSON object, its own and those of objects right in it, in the order of their names."""
    fields = lambda v: F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    own = fields(F.try_parse_json(item))
    plain = F.transform(F.filter(own, lambda e: is_text(e["value"])), lambda e: e["key"])
    objects = F.filter(own, lambda e: F.schema_of_variant(e["value"]).startswith("OBJECT"))
    nested = F.transform(objects, lambda e: F.transform(F.filter(fields(e["value"]), lambda x: is_text(x["value"])), lambda x: F.concat(e["key"], F.lit("."), x["key"])))
    return F.array_sort(F.concat(plain, F.flatten(nested)))


def collected_identifiers(body: Column, items: Column, url: Column, most: int | None = None) -> Column:
    """Identifiers of the addresses at ``items[].url`` of a JSON body (paths may be columns), in order; entries without one
    go. ``most`` bounds how many entries are looked at."""
    entries = F.coalesce(F.try_variant_get(F.try_parse_json(body), F.concat(F.lit("$."), items), "array<variant>"), F.array().cast("array<variant>"))
    looked = entries if most is None else F.slice(entries, 1, most)
    found = F.transform(looked, lambda e: F.try_variant_get(e, F.concat(F.lit("$."), url), "variant"))
    texts = F.filter(found, lambda v: F.schema_of_variant(v) == "STRING")
    return F.array_compact(F.transform(texts, lambda v: U.last_identifier(F.try_variant_get(v, "$", "string"))))


def concept_candidates(leaves: DataFrame, keys: Sequence[str], kind: str, concept: str) -> DataFrame:
    """Leaves (keys, source, seq, pos, path, value) that may hold a concept by the end of their path and whose value is of the type:
    adds transform, each path of a source once at its first place. Money under a name in cents (``price_cents``) counts
    as cents where that makes a value."""
    from skein.functions.names import fits_concept
    from skein.functions.shape import cents_to_units, infer_transform, normalize

    raw = F.col("value")
    plain = fits_concept(concept, F.col("path"))
    transform = infer_transform(kind, raw, fold=False)
    if kind == "money":
        last = F.element_at(F.split("path", r"\."), -1)
        base = F.regexp_replace("path", r"(?i)[_-]?cents?$", "")
        in_cents = last.rlike(r"(?i)cents?$") & (F.regexp_replace(last, r"(?i)[_-]?cents?$", "") != "")
        units = cents_to_units(raw)
        plain = plain | (in_cents & fits_concept(concept, base))
        transform = F.when(transform.isNotNull() & in_cents & (units != raw) & normalize(kind, units, fold=False).isNotNull(), "cents_to_units").otherwise(transform)
    fitting = leaves.where(plain).withColumn("transform", transform).where("transform IS NOT NULL")
    first = F.min_by(F.struct("value", "transform"), F.struct("seq", "pos"))
    return fitting.groupBy(*keys, "source", "path").agg(first.alias("f")).select(*keys, "source", "path", "f.*")
