"""Operators over cells: a long table (item, field, value), made from wide rows by ``unpivot_cells``.

Coverage, misses, empty shares and merges read it; all are one aggregation or one join on its keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.emptiness import is_empty, is_filled, is_present

#: A field drifts when at least this share of at least this many rows is empty.
DRIFT_SHARE, DRIFT_ROWS = 0.2, 5


def unpivot_cells(rows: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, field, value): one row per cell, values as text."""
    return rows.select(*keys, *[F.col(f"`{f}`").cast("string").alias(f) for f in fields]).unpivot(list(keys), list(fields), "field", "value")


def coverage(cells: DataFrame, absent: Column, shown: Column | None = None, defaulted: Column | None = None) -> DataFrame:
    """Per field: total, filled, confirmed_absent, missing (in that precedence), checked, not_shown, defaulted. A
    shown flag of null is not checked."""
    shown = F.lit(None).cast("boolean") if shown is None else shown
    defaulted = F.lit(False) if defaulted is None else defaulted
    filled = is_filled(F.col("value"))
    confirmed = F.coalesce(absent, F.lit(False))
    return cells.groupBy("field").agg(
        F.count("*").alias("total"),
        F.count_if(filled).alias("filled"),
        F.count_if(~filled & confirmed).alias("confirmed_absent"),
        F.count_if(~filled & ~confirmed).alias("missing"),
        F.count(shown).alias("checked"),
        F.count_if(~shown).alias("not_shown"),
        F.count_if(F.coalesce(defaulted, F.lit(False))).alias("defaulted"),
    )


def gap_items(cells: DataFrame, keys: Sequence[str], absent: Column) -> DataFrame:
    """Items with their missing fields, sorted; fields confirmed absent are no gap."""
    missing = is_empty(F.col("value")) & ~F.coalesce(absent, F.lit(False))
    return cells.where(missing).groupBy(*keys).agg(F.array_sort(F.collect_set("field")).alias("missing_fields"))


def misses(cells: DataFrame, group: str, url: str, absent: Column, urls_per_group: int = 10) -> DataFrame:
    """Per field and listing: the number of items without a value and the first addresses of them. Only the first
    addresses of each task's groups travel."""
    missing = cells.where(is_empty(F.col("value")) & ~F.coalesce(absent, F.lit(False)))
    order = W.partitionBy("field", group).orderBy(url)
    counted = missing.groupBy("field", group).agg(F.count("*").alias("count"))
    sample = missing.select("field", group, url).withColumn("n", F.row_number().over(order)).where(F.col("n") <= urls_per_group)
    urls = sample.groupBy("field", group).agg(F.array_sort(F.collect_list(url)).alias("urls"))
    same = (counted["field"] == urls["field"]) & counted[group].eqNullSafe(urls[group])
    return counted.join(urls, same).select(counted["field"], counted[group], "count", "urls")


def empty_shares(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of empty cells per field (and group)."""
    return cells.groupBy(*by, "field").agg(F.count("*").alias("rows"), F.avg(is_empty(F.col("value")).cast("double")).alias("empty_share"))


def drifted(cells: DataFrame, by: Sequence[str] = (), share: float = DRIFT_SHARE, least: int = DRIFT_ROWS) -> DataFrame:
    """Fields whose empty share reaches ``share`` over ``least`` rows or more; bookkeeping fields (``_...``) never."""
    own = ~F.col("field").startswith("_")
    return empty_shares(cells.where(own), by).where((F.col("rows") >= least) & (F.col("empty_share") >= share))


def field_coverage(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average over rows of the share of fields that are not null ('' counts)."""
    per_row = cells.groupBy(*keys).agg(F.avg(is_present(F.col("value")).cast("double")).alias("share"))
    return per_row.agg(F.coalesce(F.avg("share"), F.lit(0.0)).alias("field_coverage"))


def missing_fields(cells: DataFrame) -> DataFrame:
    """Fields present in half of the rows or fewer."""
    return cells.groupBy("field").agg(F.count("value").alias("present"), F.count("*").alias("rows")).where(F.col("present") <= F.col("rows") * 0.5)


def classify_fields(coverages: DataFrame) -> DataFrame:
    """dead: filled in under half of the items (none at all included); else alive."""
    share = F.when(F.col("total") > 0, F.col("filled") / F.col("total")).otherwise(F.lit(0.0))
    return coverages.withColumn("fill_share", share).withColumn("state", F.when(share < 0.5, "dead").otherwise("alive"))


def cross_row_issues(cells: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """(field, message): all values equal in several rows, or a required field missing in most rows."""
    stats = cells.groupBy("field").agg(F.count("*").alias("rows"), F.count("value").alias("present"), F.min("value").alias("low"), F.max("value").alias("high"))
    same = F.when(
        (F.col("present") > 1) & (F.col("low") == F.col("high")),
        F.concat(F.lit("All "), F.col("present"), F.lit(" rows have identical value — likely wrong selector")),
    )
    lacking = F.when(
        F.col("field").isin(list(required)) & (F.col("present") < F.col("rows") * 0.5),
        F.concat(F.lit("Required field missing in "), F.col("rows") - F.col("present"), F.lit("/"), F.col("rows"), F.lit(" rows")),
    )
    return stats.select("field", F.explode(F.array_compact(F.array(same, lacking))).alias("message"))


def apply_defaults(rows: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Empty cells take their field's default; ``defaulted`` lists the fields filled, in the order of ``defaults``."""
    filled = F.array_compact(F.array(*[F.when(is_empty(F.col(f)), F.lit(f)) for f in defaults]))
    out = rows.withColumn("defaulted", filled)
    return out.withColumns({f: F.when(is_empty(F.col(f)), F.lit(v)).otherwise(F.col(f).cast("string")) for f, v in defaults.items()})


def blank_defaulted(rows: DataFrame, fields: Sequence[str], defaulted: str = "defaulted") -> DataFrame:
    """Cells that a default filled read as empty again, so that drift shows."""
    return rows.withColumns({f: F.when(~F.array_contains(defaulted, f), F.col(f)) for f in fields})


def merge_backfill(parent: DataFrame, child: DataFrame, keys: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """Parent rows with empty target cells taken from the child row of equal key; filled cells never change and child
    rows without a parent are dropped. ``filled_fields`` and ``absent_fields`` list what was filled and what stays
    empty. Keys must be unique on the child's side (see ``first_per``)."""
    theirs = child.select(*keys, *[F.col(t).alias(f"_new_{t}") for t in targets])
    joined = parent.join(theirs, list(keys), "left")
    value = {t: F.when(is_filled(F.col(t)), F.col(t)).otherwise(F.col(f"_new_{t}")) for t in targets}
    newly = F.array_compact(F.array(*[F.when(is_empty(F.col(t)) & is_filled(F.col(f"_new_{t}")), F.lit(t)) for t in targets]))
    still = F.array_compact(F.array(*[F.when(is_empty(v), F.lit(t)) for t, v in value.items()]))
    rest = [c for c in parent.columns if c not in (*keys, *targets)]
    return joined.select(*keys, *rest, *[v.alias(t) for t, v in value.items()], newly.alias("filled_fields"), still.alias("absent_fields"))


def backfill_items(gaps: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Items of ``gap_items`` with a gap among the targets, and those gaps in target order."""
    wanted = F.array_intersect(F.array(*[F.lit(t) for t in targets]), F.col("missing_fields"))
    return gaps.withColumn("target_fields", wanted).where(F.size("target_fields") > 0)


def repair_verdict(items: DataFrame, by: str, order: Sequence[Column], resolved: Column, sample: int = 3, least: int = 2) -> DataFrame:
    """Of the first ``sample`` items of each group, how many resolved, and whether the sweep goes on."""
    nth = F.row_number().over(W.partitionBy(by).orderBy(*order))
    tried = items.withColumn("_n", nth).where(F.col("_n") <= sample)
    return tried.groupBy(by).agg(F.count("*").alias("tried"), F.count_if(resolved).alias("resolved")).withColumn("goes_on", F.col("resolved") >= least)


def cell_state(value: Column, absent: Column) -> Column:
    return F.when(is_filled(value), "filled").when(F.coalesce(absent, F.lit(False)), "absent").otherwise("missing")


def result_rows(rows: DataFrame, keys: Sequence[str], types: dict[str, str]) -> DataFrame:
    """(keys, name, type, value, status): one row per declared field."""
    cells = unpivot_cells(rows, keys, list(types))
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in types.items() for x in pair]), F.col("field"))
    return cells.select(*keys, F.col("field").alias("name"), kind.alias("type"), "value", F.when(is_filled(F.col("value")), "found").otherwise("not_found").alias("status"))
