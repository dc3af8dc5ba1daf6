"""The extraction chain: candidates of all tiers of a field in one ordered decision, with guards and charged misses."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.shape import shape_check
from skein.functions.text import CORROBORATED_FIELDS, CORROBORATED_SOURCES, long_words, prepared, share_of

from .relational import small

#: Tiers in the order they are asked, with the confidence of what they give (null: the candidate's own).
TIERS = {
    "selected": 0.95, "displayed": 0.95, "declared": 0.95, "mechanical": 0.8, "cached": None, "cached-xpath": 0.85, "override": 0.95,
    "variants": 0.6, "api-ai": None, "row-plan": 0.85, "xpath": 0.7, "vision": 0.5,
}
#: Tiers that read stored paths: a path that gives nothing usable is charged a miss.
STORED = ("cached", "cached-xpath")


def _tier(values: list) -> Column:
    """The entry of ``values`` at the candidate's tier."""
    return F.element_at(F.array(*[F.lit(v).cast("double") for v in values]), F.col("turn"))


def shown_shares(candidates: DataFrame, pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, value, share: how much of each name-like value of a recorded response the page's text shows. A page's values
    meet its text (column page_text) once; nulls where the text or the value has no words."""
    asked = candidates.where(F.col("source").isin(CORROBORATED_SOURCES) & F.col("field").isin(CORROBORATED_FIELDS) & F.col("value").isNotNull())
    values = asked.groupBy(*keys).agg(F.collect_set("value").alias("_values"))
    text = pages.select(*keys, F.col("page_text").alias("_text")).where("_text <> ''")
    # an element of an array: the text is prepared once a page
    shares = F.transform(F.array(prepared(F.col("_text"))), lambda seen: F.transform("_values", lambda v: F.struct(v.alias("value"), share_of(long_words(v), seen).alias("share"))))[0]
    return values.join(text, list(keys)).select(*keys, F.explode(shares).alias("s")).select(*keys, "s.*")


def judged(candidates: DataFrame, fields: DataFrame, pages: DataFrame, keys: Sequence[str], share: float = 0.6) -> DataFrame:
    """Candidates with turn (place of their tier), normal (the value as stored) and refused (why it can't stand, else
    null): absent, row-scoped, the shape's reason, not corroborated. Candidates of undeclared fields or tiers go."""
    turn = F.element_at(F.create_map(*[F.lit(x) for n, t in enumerate(TIERS) for x in (t, n + 1)]), F.col("tier"))
    typed = candidates.withColumn("turn", turn).where("turn IS NOT NULL").join(small(fields.select("field", "type", F.coalesce("row_scoped", F.lit(False)).alias("row_scoped"))), "field")
    kinds = [(F.col("type") == "number", shape_check(F.col("value"), "number")), ((F.col("type") == "string") & (F.col("field") == "description"), shape_check(F.col("value"), "string", "description")), (F.col("type") == "string", shape_check(F.col("value"), "string"))]
    shape = reduce(lambda rest, k: F.when(k[0], k[1]).otherwise(rest), reversed(kinds), shape_check(F.col("value"), "other"))
    seen = shown_shares(candidates, pages, keys).withColumnRenamed("share", "_share")
    source_binds = F.col("source").isin(CORROBORATED_SOURCES) & F.col("field").isin(CORROBORATED_FIELDS)
    known = typed.join(seen, [*keys, "value"], "left").withColumn("_shape", shape)
    refused = (
        F.when(F.col("value").isNull(), "absent")
        .when(F.col("row_scoped") & (F.col("source") != "xpath"), "row-scoped")
        .when(~F.col("_shape.ok"), F.col("_shape.reason"))
        .when(source_binds & (F.col("_share") < share), "not corroborated")
    )
    return known.withColumn("normal", F.col("_shape.normalized")).withColumn("refused", refused).drop("_shape", "_share")


def decide(told: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``judged`` candidates (with place: their order within a tier, no ties) with outcome:

    taken        the value of the field: the first usable one of the chain, or a usable override of a later turn
    overridden   the first usable one, where an override took its place; what was selected or displayed is never replaced
    refused      asked, and refused by a guard
    not asked    behind the value that stood when its turn came
    """
    good, own = F.col("refused").isNull(), [*keys, "field"]
    at = F.struct("turn", "place")
    over = F.col("tier") == "override"
    first = lambda which: F.min(F.when(which, at)).over(W.partitionBy(*own))
    known = told.withColumns({"_plain": first(good & ~over), "_over": first(good & over)})
    firm = F.coalesce(F.col("_plain.turn") <= list(TIERS).index("displayed") + 1, F.lit(False))
    winner = F.when(F.col("_over").isNotNull() & ~firm, F.col("_over")).otherwise(F.col("_plain"))
    stood = F.when(over, F.when(firm, F.col("_plain")).otherwise(F.col("_over"))).otherwise(F.least("_plain", winner))
    asked = stood.isNull() | (at <= stood)
    outcome = (
        F.when(~asked, "not asked")
        .when(~good, "refused")
        .when(F.coalesce(at == winner, F.lit(False)), "taken")
        .when(F.coalesce(at == F.col("_plain"), F.lit(False)), "overridden")
        .otherwise("not asked")
    )
    return known.withColumn("outcome", outcome).drop("_plain", "_over")


def chain_values(decided: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, field, value, source, path, tier, confidence of the fields that have a value."""
    worth = F.coalesce(_tier(list(TIERS.values())), F.col("confidence"))
    return decided.where("outcome = 'taken'").select(*keys, "field", F.col("normal").alias("value"), "source", "path", "tier", worth.alias("confidence"))


def chain_observations(decided: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What the chain teaches about paths, for the store's merge: a hit for each value, a miss for each stored path that was
    asked and gave nothing usable (fields of rows do not ask them). keys, field, source, path, hit, value, confidence."""
    stored = F.col("tier").isin(*STORED)
    worth = F.coalesce(_tier(list(TIERS.values())), F.col("confidence"))
    seen = decided.where((F.col("outcome") == "taken") | (stored & ~F.col("row_scoped") & (F.col("outcome") == "refused")))
    hit = F.col("outcome") == "taken"
    return seen.where("path IS NOT NULL AND path <> ''").select(*keys, "field", "source", "path", hit.alias("hit"), F.when(hit, F.col("normal")).alias("value"), worth.alias("confidence"))
