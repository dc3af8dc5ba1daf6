"""Certification of extraction paths against expected cells, drift classes, refresh plans.

The evaluation of candidates on pages is a table; what needs a search per field (the cover) runs over that field's
few candidates and pages.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.emptiness import is_empty

from .labels import spread_labels
from .ranking import MOST_PATHS, rank_certified, spread_sources


def evaluate(readings: DataFrame, expected: DataFrame, equal: Column, equal_default: Column | None = None) -> DataFrame:
    """Readings (field, url, source, path, raw) against cells (field, url, expected, absent, default_cell): adds empty,
    correct and proven. On an absent page nothing is right, on a default cell nothing or the default, else the
    expected value."""
    empty = is_empty(F.col("raw"))
    default = F.coalesce(equal_default, F.lit(False)) if equal_default is not None else F.lit(False)
    correct = F.when(F.col("absent"), empty).when(F.col("default_cell"), empty | default).otherwise(~empty & F.coalesce(equal, F.lit(False)))
    joined = readings.join(expected, ["field", "url"])
    return joined.withColumn("empty", empty).withColumn("correct", correct).withColumn("proven", F.col("correct") & ~F.col("empty") & ~F.col("absent"))


def safe_paths(evaluated: DataFrame) -> DataFrame:
    """Per candidate: safe (right or empty on every page), everywhere (right on all), proven_pages, wrong_pages."""
    return evaluated.groupBy("field", "source", "path").agg(
        F.min(F.col("correct") | F.col("empty")).alias("safe"),
        F.min("correct").alias("everywhere"),
        F.count_if("proven").alias("proven_pages"),
        F.count_if(~F.col("correct") & ~F.col("empty")).alias("wrong_pages"),
    )


def one_layout(evaluated: DataFrame, with_default: bool = False) -> DataFrame:
    """Paths right on every page, ranked, spread over sources, five at most: (field, source, path, place). With a
    default a path must also read a value on two pages."""
    good = safe_paths(evaluated).where("safe AND everywhere")
    if with_default:
        good = good.where("proven_pages >= 2")
    ranked = rank_certified(good.withColumn("pinned", F.lit(False)), ["field"])
    return spread_sources(ranked, ["field"], "source").select("field", "source", "path", "place")


def _cover(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
    """Greedy cover of one field's valued pages by safe paths, most new pages first, better rank on ties."""
    proven = {rank: set(rows.loc[rows["proven"], "url"]) for rank, rows in cells.groupby("rank")}
    open_pages, chosen = set(cells["url"]), []
    while open_pages and len(chosen) < MOST_PATHS:
        gain, rank = max(((len(pages & open_pages), -r) for r, pages in proven.items() if r not in chosen), default=(0, 0))
        if gain == 0:
            break
        chosen.append(-rank)
        open_pages -= proven[-rank]
    if open_pages or not chosen or max(len(proven[r]) for r in chosen) < 2:
        chosen = []
    chosen.sort(key=lambda r: (-len(proven[r]), r))
    return pd.DataFrame({"field": key[0], "rank": chosen, "place": range(1, len(chosen) + 1), "pages": [len(proven[r]) for r in chosen]})


def cover(evaluated: DataFrame) -> DataFrame:
    """Exceptions beside a common layout: safe paths that together read every valued page, one of them two pages or
    more. Fields that cannot be covered give no rows. A field has a handful of proof pages and candidates."""
    safe = rank_certified(safe_paths(evaluated).where("safe"), ["field"]).select("field", "source", "path", "rank")
    valued = evaluated.where("NOT absent AND NOT default_cell").join(safe, ["field", "source", "path"]).select("field", "rank", "url", "proven")
    chosen = valued.groupBy("field").applyInPandas(_cover, "field string, rank int, place int, pages int")
    return chosen.join(safe, ["field", "rank"]).select("field", "source", "path", "place", "pages")


def certify(evaluated: DataFrame, with_default: bool = False) -> DataFrame:
    """Certified paths per field: one layout where some path is right everywhere, else a cover. Adds how."""
    whole = one_layout(evaluated, with_default).withColumn("how", F.lit("layout"))
    rest = evaluated.join(whole.select("field").distinct(), "field", "left_anti")
    return whole.unionByName(cover(rest).drop("pages").withColumn("how", F.lit("cover")))


def cell_results(evaluated: DataFrame, certified: DataFrame) -> DataFrame:
    """(field, url, result): pass by the first certified path that is right there, else what went wrong: elsewhere
    (a path right on all other pages reads another value here), not_found, ambiguous."""
    marked = evaluated.join(certified.select("field", "source", "path", "place"), ["field", "source", "path"], "left")
    others = safe_paths(evaluated).select("field", "source", "path", "wrong_pages")
    stats = marked.join(others, ["field", "source", "path"])
    by_cell = stats.groupBy("field", "url").agg(
        F.max(F.coalesce(F.col("correct") & F.col("place").isNotNull(), F.lit(False))).alias("passes"),
        F.max(~F.col("correct") & ~F.col("empty") & (F.col("wrong_pages") == 1)).alias("elsewhere"),
        F.max("correct").alias("someone"),
    )
    result = F.when(F.col("passes"), "pass").when(F.col("elsewhere"), "elsewhere").when(F.col("someone"), "ambiguous").otherwise("not_found")
    return by_cell.select("field", "url", result.alias("result"))


def weak_fields(expected: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Fields whose proof says little: yes/no fields, and those with two equal expected values."""
    booleans = [f for f, k in kinds.items() if k == "boolean"]
    stats = expected.where(F.col("expected").isNotNull()).groupBy("field").agg((F.count("*") > F.count_distinct("expected")).alias("repeats"))
    return stats.withColumn("weak", F.col("repeats") | F.col("field").isin(booleans)).select("field", "weak")


def response_groups(reads: DataFrame) -> DataFrame:
    """Paths that read one response on one page are one source, transitively: (path, group), the group named by its
    smallest path. Each read links its paths to the smallest of them; labels spread over those links until they settle."""
    pairs = reads.where("path IS NOT NULL").select("path", F.concat_ws("\n", "url", "response").alias("read")).distinct()
    least = pairs.groupBy("read").agg(F.min("path").alias("root"))
    labels = spread_labels(pairs.join(least, "read").select(F.col("path").alias("leaf"), "root"))
    return pairs.select("path").distinct().join(labels.withColumnRenamed("node", "path"), "path", "left").select("path", F.coalesce("label", "path").alias("group"))


def drift_class(flags: DataFrame, unread: DataFrame | None = None) -> DataFrame:
    """Flags per (field, page, path): certified_path, fits, equal, reads. Per field the first that holds: other-layout
    (a certified path equals on every page), moved (some other path does, on two pages or more), changed (a certified
    or fitting path reads a value on every page), lost. A field of ``unread`` (field, page: could not be read now)
    without any page that was read is not-checked."""
    per_path = flags.groupBy("field", "path").agg(
        F.min("equal").alias("all_equal"), F.min("reads").alias("all_read"), F.max("certified_path").alias("own"), F.max("fits").alias("fits"), F.count("*").alias("pages")
    )
    per_field = per_path.groupBy("field").agg(
        F.max(F.col("own") & F.col("all_equal")).alias("other"),
        F.max(~F.col("own") & F.col("all_equal") & (F.col("pages") >= 2)).alias("moved"),
        F.max((F.col("own") | F.col("fits")) & F.col("all_read")).alias("changed"),
    )
    kind = F.when(F.col("other"), "other-layout").when(F.col("moved"), "moved").when(F.col("changed"), "changed").otherwise("lost")
    classes = per_field.select("field", kind.alias("drift"))
    if unread is None:
        return classes
    unknown = unread.select("field").distinct().join(classes, "field", "left_anti")
    return classes.unionByName(unknown.withColumn("drift", F.lit("not-checked")))


REFUSALS = ("not-by-nature", "too-few-pages", "empty", "not-same-place", "fixed-variant", "not-shown", "out-of-range")


def refresh_plan(pages: DataFrame, least: int = 2) -> DataFrame:
    """All or nothing per field: pages (field, url, was, now, by_nature, same_place, fixed_variant, shown, in_range) give
    the first refusal in a fixed order, or null and the number of changed pages."""
    stats = pages.groupBy("field").agg(
        F.count("*").alias("n"),
        F.min("by_nature").alias("by_nature"),
        F.max(is_empty(F.col("now"))).alias("empty"),
        F.min("same_place").alias("same_place"),
        F.max("fixed_variant").alias("fixed_variant"),
        F.min(F.coalesce("shown", F.lit(True))).alias("shown"),
        F.min("in_range").alias("in_range"),
        F.count_if(~F.col("was").eqNullSafe(F.col("now"))).alias("changed"),
    )
    tests = [~F.col("by_nature"), F.col("n") < least, F.col("empty"), ~F.col("same_place"), F.col("fixed_variant"), ~F.col("shown"), ~F.col("in_range")]
    reason = F.coalesce(*[F.when(test, F.lit(name)) for test, name in zip(tests, REFUSALS)])
    return stats.select("field", reason.alias("refusal"), "changed")


def currency(results: DataFrame, hashes: DataFrame, source: str) -> DataFrame:
    """Latest clean verification per source and field against today's definition hash: current if equal and passed,
    held if an earlier pass (column hold_hash) matches, else stale."""
    newest = results.where("status = 'completed' AND error IS NULL").groupBy(source, "field").agg(
        F.max_by(F.struct("field_hash", "passes", "hold_hash"), F.struct("completed_at", "id")).alias("r")
    )
    joined = newest.join(hashes, [source, "field"])
    current = (F.col("r.field_hash") == F.col("hash")) & F.col("r.passes")
    state = F.when(current, "current").when(F.col("r.hold_hash") == F.col("hash"), "held").otherwise("stale")
    return joined.select(source, "field", state.alias("state"))


def definition_hash(*columns: Column) -> Column:
    """Content hash of a field's definition: canonical JSON, so that it changes only with the content."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def lean_agreement(readings: DataFrame, run: str, order: Sequence[str], streak: int = 3) -> DataFrame:
    """Readings of pages taken both ways (columns lean, full, as text): per page disagreed and rescued, and whether the
    run has switched to full pages by then: one disagreement, or ``streak`` rescued pages in a row."""
    from pyspark.sql import Window as W

    disagreed = F.col("lean").isNotNull() & ~F.col("lean").eqNullSafe(F.col("full"))
    rescued = F.col("lean").isNull() & F.col("full").isNotNull()
    per_page = readings.groupBy(run, *order).agg(F.max(disagreed).alias("disagreed"), F.max(rescued).alias("rescued"))
    upto = W.partitionBy(run).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    last = W.partitionBy(run).orderBy(*order).rowsBetween(-(streak - 1), 0)
    in_row = (F.sum(F.col("rescued").cast("int")).over(last) == streak)
    flagged = per_page.withColumn("_now", F.col("disagreed") | in_row)
    return flagged.withColumn("full_mode", F.max("_now").over(upto)).drop("_now")
