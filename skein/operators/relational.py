"""Relational building blocks: latest and first rows per key, roll-ups over a spine of dimensions, set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Estimated bytes up to which a dimension is sent to every executor; larger ones are left to the optimizer.
BROADCAST_BYTES = 64 * 1024 * 1024


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if the optimizer's own size estimate is within ``limit``, else as it is."""
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(estimate)) <= limit else df


def latest_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``; ties must be broken by the caller. One shuffle on the keys: the row
    travels as a struct through a partial maximum only where the order is a single column, else by window."""
    ranked = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(ranked)).where("_nth = 1").drop("_nth")


first_per = latest_per


def latest_struct(df: DataFrame, keys: Sequence[str], by: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Like ``latest_per`` for descending order on ``by``, with map-side combining: hot keys shuffle one row a task."""
    best = F.max_by(F.struct(*keep), F.struct(*by))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def spine(fact: DataFrame, *dimensions: tuple[DataFrame, str, str]) -> DataFrame:
    """Inner joins along a spine: each dimension comes with the key on the left and its own key."""
    return reduce(lambda df, d: df.join(small(d[0]), F.col(d[1]) == F.col(d[2])), dimensions, fact)


def counts_with_zero(parents: DataFrame, parent_key: str, children: DataFrame, child_key: str, name: str) -> DataFrame:
    """Every parent with its number of children. Children are counted before the join, so a hot parent moves once."""
    counted = children.groupBy(F.col(child_key).alias("_k")).agg(F.count("*").alias(name))
    return parents.join(counted, parents[parent_key] == counted["_k"], "left").drop("_k").withColumn(name, F.coalesce(name, F.lit(0)))


def merged_facts(base: DataFrame, key: str, facts: Sequence[tuple[DataFrame, str, int | None]]) -> DataFrame:
    """``base`` keys with several pre-aggregated facts, zero-filled; a number of digits rounds by floor(x + 0.5)."""
    out = base
    for fact, name, digits in facts:
        out = out.join(fact.select(key, name), key, "left")
        filled = F.coalesce(F.col(name), F.lit(0))
        if digits is not None:
            filled = F.floor(filled.cast("double") * 10**digits + 0.5) / 10**digits
        out = out.withColumn(name, filled)
    return out


def exists_in(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(other.select(*on), list(on), "left_semi")


def missing_from(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Anti join; unlike NOT IN a null on the other side removes nothing."""
    return df.join(other.select(*on), list(on), "left_anti")


def union_sources(named: Sequence[tuple[str, DataFrame]], label: str = "Website") -> DataFrame:
    """Rows of several outputs by column name, each marked with its source; missing columns are null. A customer column
    of the label's name becomes ``label (field)``."""
    marked = []
    for name, df in named:
        renamed = df.withColumnRenamed(label, f"{label} (field)")
        marked.append(renamed.select(F.lit(name).alias(label), *[F.col(f"`{c}`") for c in renamed.columns]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def streaks(df: DataFrame, key: str, order: Sequence[str], hit: Column, least: int) -> DataFrame:
    """Runs of at least ``least`` consecutive hits per key: key, first and last order value, length."""
    over = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    marked = df.withColumn("_hit", hit).withColumn("_island", F.sum((~F.col("_hit")).cast("int")).over(over))
    runs = marked.where("_hit").groupBy(key, "_island").agg(
        F.count("*").alias("length"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last")
    )
    return runs.where(F.col("length") >= least).drop("_island")


def cycle_times(df: DataFrame, key: str, order: Sequence[str], at: str) -> DataFrame:
    """Seconds between consecutive rows of a key; null for the first."""
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    before = F.lag(seconds).over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("cycle_seconds", seconds - before)


def floor_percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], bins: int = 4096) -> DataFrame:
    """Order statistics at position floor(q * n), the last one at most, with the rows counted per key.

    A key may hold a third of all rows, so no task sorts a whole key: equal values are counted first, their counts are
    added up in ``bins`` ranges between the key's smallest and largest value, and only the ranges that hold a wanted
    position are sorted.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    ends = counted.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.sum("_c").alias("n"))
    width = F.col("_high").cast("double") - F.col("_low").cast("double")
    at = F.when(width > 0, F.floor((F.col(value).cast("double") - F.col("_low").cast("double")) / width * bins)).otherwise(F.lit(0))
    binned = counted.join(small(ends), list(keys)).withColumn("_bin", at.cast("long"))
    sums = binned.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_in"), F.first("n").alias("n"))
    upto = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    wanted = F.array(*[F.least(F.floor(F.lit(q) * F.col("n")), F.col("n") - 1) for q in shares.values()])
    placed = sums.withColumn("_before", F.sum("_in").over(upto) - F.col("_in")).withColumn(
        "_hits", F.filter(wanted, lambda p: (p >= F.col("_before")) & (p < F.col("_before") + F.col("_in")))
    )
    holding = placed.where(F.size("_hits") > 0).select(*keys, "_bin", "_before")
    inside = W.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    sorted_in = binned.join(small(holding), [*keys, "_bin"]).withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))
    position = lambda q: F.least(F.floor(F.lit(q) * F.col("n")), F.col("n") - 1)
    picks = [F.min(F.when((F.col("_upto") > position(q)) & (F.col("_upto") - F.col("_c") <= position(q)), F.col(value))).alias(name) for name, q in shares.items()]
    return sorted_in.groupBy(*keys).agg(F.max("n").alias("n"), *picks)


def merge_maps(old: Column, new: Column) -> Column:
    """Keys of both maps; where both have one, the value of ``new`` stands, a null too. A null map is an empty one."""
    told = F.coalesce(F.map_keys(new), F.array().cast("array<string>"))
    nothing = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(old, nothing), F.coalesce(new, nothing), lambda k, a, b: F.when(F.array_contains(told, k), b).otherwise(a))


def sum_maps(rows: DataFrame, keys: Sequence[str], counts: str) -> DataFrame:
    """Maps of counts added up key by key: a partial sum per name before anything moves, one map a group at the end."""
    names = rows.select(*keys, F.explode(counts).alias("_name", "_count"))
    sums = names.groupBy(*keys, "_name").agg(F.sum("_count").alias("_count"))
    return sums.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_name", "_count")))).alias(counts))


def concatenated(rows: DataFrame, keys: Sequence[str], order: Sequence[str], items: str) -> DataFrame:
    """The arrays ``items`` of each group one after another, in order, as rows: keys, item (from 0), value. Empty and null
    arrays add nothing."""
    exploded = rows.select(*keys, *order, F.posexplode(items).alias("_pos", "value"))
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*order, "_pos")) - 1
    return exploded.select(*keys, nth.cast("long").alias("item"), "value")
