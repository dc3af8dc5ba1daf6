"""Run, usage and review reports: conditional aggregates and ordered decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def status_counts(items: DataFrame, by: Sequence[str]) -> DataFrame:
    states = {"pending": "pending", "running": "running", "done": "done", "failed": "failed"}
    return items.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(n) for n, s in states.items()])


def run_status(cancelled: Column, limit_reached: Column, has_error: Column) -> Column:
    """Status of a run from its item counts; the first rule that holds."""
    going = (F.col("pending") + F.col("running")) > 0
    return (
        F.when(going & cancelled, "cancelled")
        .when(going & limit_reached, "partial")
        .when(going, "extracting")
        .when(has_error & (F.col("done") == 0) & (F.col("failed") == 0), "failed")
        .when(F.col("failed") == 0, "completed")
        .when(F.col("done") > 0, "partial")
        .otherwise("failed")
    )


def first_error(items: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Error of the first failed item in order."""
    return items.where("status = 'failed'").groupBy(*by).agg(F.min_by("error", F.struct(*order)).alias("first_error"))


def verdict_summary(verdicts: DataFrame, by: Sequence[str]) -> DataFrame:
    """correct, wrong and missing per group, and correct / (correct + wrong) in percent, null without either."""
    counted = verdicts.groupBy(*by).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("correct", "wrong", "missing")])
    judged = F.col("correct") + F.col("wrong")
    return counted.withColumn("percent", F.when(judged > 0, F.col("correct") * 100.0 / judged))


def probability_bucket(p: Column) -> Column:
    return F.when(p >= 0.9, ">=0.9").when(p >= 0.8, "0.8-0.9").when(p >= 0.6, "0.6-0.8").otherwise("<0.6")


def agreement(pairs: DataFrame, by: Sequence[str], agrees: Column) -> DataFrame:
    return pairs.groupBy(*by).agg(F.count("*").alias("judged"), F.count_if(agrees).alias("agreed")).withColumn("share", F.col("agreed") / F.col("judged"))


def cap_state(cap: Column, spent: Column) -> list[Column]:
    """remaining, reached and percent_used of a spending cap. A null cap is none; a cap of 0 is all used."""
    rounded = F.floor((cap - spent) * 10_000 + 0.5) / 10_000
    remaining = F.when(cap.isNotNull(), F.greatest(F.lit(0.0), rounded))
    percent = F.when(cap == 0, F.lit(100.0)).otherwise(F.floor(spent / cap * 1000 + 0.5) / 10)
    return [remaining.alias("remaining"), F.coalesce(spent >= cap, F.lit(False)).alias("reached"), percent.alias("percent_used")]


def cost_usd(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of token counts (input, output, cache_write, cache_read) by model, prices per million: cache writes at 1.25
    and reads at a tenth of the input price. Unknown models cost 0 and are marked."""
    from .relational import small

    joined = usage.join(small(prices), "model", "left")
    units = (F.col("input") + 1.25 * F.col("cache_write") + 0.1 * F.col("cache_read")) * F.col("input_price") + F.col("output") * F.col("output_price")
    return joined.withColumns({"cost_usd": F.coalesce(units / 1e6, F.lit(0.0)), "known": F.col("input_price").isNotNull()})


COUNTERS = ("input", "output", "cache_write", "cache_read", "requests")


def usage_difference(before: DataFrame, after: DataFrame, key: str = "model") -> DataFrame:
    """What the counters of ``after`` grew by since ``before``, per model; models that are new count whole, and those
    without new requests, input or output are left out. Both tables have one row a model."""
    from .relational import small

    earlier = small(before.select(key, *[F.col(c).alias(f"_{c}") for c in COUNTERS]))
    grown = after.join(earlier, key, "left").select(key, *[(F.col(c) - F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in COUNTERS])
    return grown.where("requests > 0 OR input > 0 OR output > 0")


SEVERITY = ("blocked", "wrong-page", "pagination", "dead-link", "extraction")


def diagnosis(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """The gravest finding of each group."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("kind"))
    return findings.where(rank > 0).groupBy(*by).agg(F.min_by("kind", rank).alias("diagnosis"))


def coverage_explanations(pages: DataFrame, features: Sequence[str], empty: Column, proof: Column, share: float = 0.8) -> DataFrame:
    """Features (boolean columns) that at least ``share`` of the pages with an empty field have and no proof page has."""
    long = pages.select(empty.alias("_e"), proof.alias("_p"), *features).unpivot(["_e", "_p"], list(features), "feature", "has")
    stats = long.groupBy("feature").agg(
        F.count_if("_e").alias("empty_pages"), F.count_if(F.col("_e") & F.col("has")).alias("with_feature"), F.count_if(F.col("_p") & F.col("has")).alias("proof_with")
    )
    return stats.where((F.col("empty_pages") > 0) & (F.col("with_feature") >= share * F.col("empty_pages")) & (F.col("proof_with") == 0))


def representative(pages: DataFrame, shape: str, order: str, value: str) -> DataFrame:
    """First page of the largest shape group; of equal groups the one seen first."""
    groups = pages.groupBy(shape).agg(F.count("*").alias("pages"), F.min(order).alias("first"), F.min_by(value, order).alias(value))
    return groups.agg(F.max_by(F.struct(shape, "pages", value), F.struct("pages", -F.col("first"))).alias("g")).select("g.*")


def path_conflicts(paths: DataFrame, keys: Sequence[str], label: str | None = None, tolerance: float = 0.05) -> DataFrame:
    """Fields where two or more paths hold a value, none protected, all last read on one address (paths without one
    count anywhere), not all of them candidates with labels of their own, and some two values differ (``nearly_equal``).
    Which two does not matter, so groups are added up: of positive numbers the largest and the smallest differ most, a
    text differs from all else, a zero from any other number that is not above it."""
    from skein.functions.numbers import leading_number

    valued = paths.where(F.col("last_value").isNotNull())
    text = F.lower(F.trim("last_value"))
    number = leading_number(F.regexp_replace("last_value", r"[^0-9.\-]", ""))
    read = valued.select("*", text.alias("_text"), number.alias("_number"))
    labelled = F.lit(False) if label is None else F.count_distinct(label) == F.count("*")
    high, low = F.max("_number"), F.min("_number")
    stats = read.groupBy(*keys).agg(
        F.count("*").alias("paths"), F.count_distinct("last_url").alias("urls"), F.max(F.coalesce("protected", F.lit(False))).alias("guarded"), labelled.alias("labelled"),
        F.count_distinct("_text").alias("values"),
        F.max(F.col("_number").isNull()).alias("plain"),
        F.coalesce((high > 0) & ((high - low) / high >= tolerance), F.lit(False)).alias("apart"),
        F.count_distinct(F.when(F.col("_number") == 0, F.col("_text"))).alias("zeros"),
        F.count_distinct(F.when(F.col("_number") <= 0, F.col("_text"))).alias("unsigned"),
    )
    differs = (F.col("values") >= 2) & (F.col("plain") | F.col("apart") | ((F.col("zeros") > 0) & (F.col("unsigned") >= 2)))
    return stats.where((F.col("paths") >= 2) & (F.col("urls") <= 1) & ~F.col("guarded") & ~F.col("labelled") & differs).select(*keys, "paths")


def attention(checks: DataFrame, source: str, recent: int = 5) -> DataFrame:
    """Fields that need a look: the newest of a source's ``recent`` last checks of the field failed and is newer than
    the source's last clean verification (column verified_at)."""
    nth = F.dense_rank().over(W.partitionBy(source).orderBy(F.col("checked_at").desc()))
    last = checks.withColumn("_n", nth).where(F.col("_n") <= recent)
    newest = last.groupBy(source, "field").agg(F.max_by(F.struct("outcome", "checked_at", "verified_at"), "checked_at").alias("c")).select(source, "field", "c.*")
    return newest.where((F.col("outcome") != "ok") & (F.col("verified_at").isNull() | (F.col("checked_at") > F.col("verified_at"))))


def overview_order(rows: DataFrame) -> DataFrame:
    """Drift first, then failed, then unverified, then the rest; names in byte order."""
    rank = F.when(F.col("drifted"), 0).when(F.col("last_status") == "failed", 1).when(~F.col("verified"), 2).otherwise(3)
    return rows.withColumn("rank", rank).orderBy("rank", "name")


def path_percent(hits: Column, misses: Column) -> Column:
    return F.when(hits + misses > 0, F.floor(hits * 100.0 / (hits + misses) + 0.5))
