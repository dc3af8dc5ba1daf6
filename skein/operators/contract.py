"""The contract: an ordered list of typed fields, as metadata of the plan."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPARK_TYPES = {
    "text": T.StringType(),
    "number": T.DoubleType(),
    "money": T.DecimalType(18, 2),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "url": T.StringType(),
    "image": T.StringType(),
    "text_list": T.ArrayType(T.StringType()),
}
# What the extraction chain calls each public type.
AGENT_TYPES = {"text": "string", "number": "number", "money": "price", "boolean": "boolean", "date": "date", "url": "url", "image": "image_url", "text_list": "array"}
VARIANT_CONCEPTS = ("price", "regular_price", "discount", "unit_price", "sku", "url", "availability", "stock_count", "image_url", "additional_images")


@dataclass(frozen=True)
class Field:
    key: str
    name: str
    type: str = "text"
    concept: str | None = None
    level: str | None = None
    enabled: bool = True

    @property
    def effective_level(self) -> str:
        return self.level or ("variant" if self.concept in VARIANT_CONCEPTS else "product")


def derive_key(name: str, taken: Iterable[str] = ()) -> str:
    """Snake-cased key of a label; a taken key gets ``_2``, ``_3``."""
    base = re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_") or "field"
    used, key, n = set(taken), base, 2
    while key in used:
        key, n = f"{base}_{n}", n + 1
    return key


@dataclass(frozen=True)
class Contract:
    fields: tuple[Field, ...]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.key, SPARK_TYPES[f.type], True, {"name": f.name, "concept": f.concept or "", "level": f.effective_level}) for f in self.fields if f.enabled])

    def select(self, rows: DataFrame) -> DataFrame:
        """Contract columns in order, missing ones null, then the columns the contract does not know."""
        known = [f.key for f in self.fields if f.enabled]
        own = [F.col(f"`{k}`") if k in rows.columns else F.lit(None).cast("string").alias(k) for k in known]
        return rows.select(*own, *[F.col(f"`{c}`") for c in rows.columns if c not in known])

    def add(self, name: str, type: str = "text", concept: str | None = None) -> Contract:
        key = derive_key(name, (f.key for f in self.fields))
        return Contract((*self.fields, Field(key, name, type, concept)))

    def rename(self, key: str, name: str) -> Contract:
        return Contract(tuple(Field(f.key, name, f.type, f.concept, f.level, f.enabled) if f.key == key else f for f in self.fields))

    def retype(self, key: str, type: str) -> Contract:
        return Contract(tuple(Field(f.key, f.name, type, f.concept, f.level, f.enabled) if f.key == key else f for f in self.fields))

    def drop(self, key: str) -> Contract:
        return Contract(tuple(f for f in self.fields if f.key != key))


def effective_fields(*choices: Sequence[Field] | None) -> tuple[Field, ...]:
    """The first contract that has fields: customer's, dataset's, legacy."""
    return next((tuple(c) for c in choices if c), ())


def parse_field_list(texts: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    """Free-text field lists: split at line breaks, or at commas in a text of one line; the first of ``:`` and `` - ``
    parts name and hint. One row per distinct key, at its first place, with hint and the type the name suggests."""
    whole = F.col(text_col)
    split = F.when(F.contains(whole, F.lit("\n")), F.split(whole, "\n")).otherwise(F.split(whole, ","))
    items = F.filter(F.transform(split, F.trim), lambda x: x != "")
    rows = texts.select(*keys, F.posexplode(items).alias("pos", "item"))
    name = F.trim(F.regexp_extract("item", r"^(.*?)(?::| - |$)", 1))
    hint = F.trim(F.regexp_extract("item", r"^.*?(?::| - )(.*)$", 1))
    cased = F.regexp_replace(F.regexp_replace(name, r"([a-z])([A-Z])", "$1_$2"), r"[\s-]+", "_")
    key = F.lower(F.regexp_replace(cased, "[^a-zA-Z0-9_]", ""))
    made = rows.select(*keys, "pos", key.alias("key"), F.nullif(hint, F.lit("")).alias("hint"), inferred_type(key).alias("type")).where("key != ''")
    first = F.row_number().over(W.partitionBy(*keys, "key").orderBy("pos"))
    return made.withColumn("_n", first).where("_n = 1").drop("_n")


# What in a field's name suggests its type; the first that fits counts.
NAME_HINTS = [
    ("price", r"price|cost|discount_amount"),
    ("image_url", r"image"),
    ("url", r"^url$|_url|link|href"),
    ("number", r"rating|count|number"),
    ("boolean", r"in_stock|available|^is_|^has_"),
    ("date", r"date|time|publish"),
    ("array", r"features|tags"),
]


def inferred_type(key: Column) -> Column:
    """Agent type that a snake-cased field name suggests."""
    chosen = F.lit("string")
    for kind, pattern in reversed(NAME_HINTS):
        chosen = F.when(key.rlike(pattern), kind).otherwise(chosen)
    return chosen


def schema_changes(paths: DataFrame, fresh: DataFrame) -> DataFrame:
    """(field, change) of a fresh extraction (field, found) against the store of paths: field_added (not in the store),
    field_removed (in the store with more than five uses, not extracted), field_degraded (in both, but no value found and
    all its paths used more than ten times and hit in under half)."""
    total = F.col("hits") + F.col("misses")
    stored = paths.groupBy("field").agg(F.sum(total).alias("uses"), F.min((total > 10) & (F.col("hits") / total < 0.5)).alias("weak"))
    both = stored.join(fresh, "field", "full")
    change = (
        F.when(F.col("uses").isNull(), "field_added")
        .when(F.col("found").isNull(), F.when(F.col("uses") > 5, "field_removed"))
        .when(F.col("weak") & ~F.col("found"), "field_degraded")
    )
    return both.select("field", change.alias("change")).where("change IS NOT NULL")
