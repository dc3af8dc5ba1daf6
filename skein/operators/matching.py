"""Matches between tables and arrays: first hits, page variants, reconciliation of rows with a link group, pager probes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import urls as U
from skein.functions.emptiness import is_filled
from skein.functions.json_leaves import by_path


def first_hit(containers: DataFrame, paths: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """For each path the first container (keys, seq, url, body) of a page in which it leads to a filled value: (keys,
    path, value, response). Each body is read once for all paths."""
    read = containers.select(*keys, "seq", U.response_key(F.col("url")).alias("response"), "body", F.explode(F.array(*map(F.lit, paths))).alias("path"))
    valued = read.withColumn("value", by_path(F.col("body"), F.col("path"))).where(is_filled(F.col("value")))
    best = F.min_by(F.struct("value", "response"), F.col("seq"))
    return valued.groupBy(*keys, "path").agg(best.alias("b")).select(*keys, "path", "b.*")


def entry_matches(entry_ids: Column, entry_pairs: Column, entry_labels: Column, ids: Column, pairs: Column, labels: Column) -> Column:
    """An entry describes the page's variant: a shared id; else option pairs (maps by label form) of which one agrees and
    none differs; else, where no pair differs, a label equal to one of the page's."""
    by_id = F.arrays_overlap(entry_ids, ids)
    shared = F.filter(F.map_keys(pairs), lambda k: F.map_contains_key(entry_pairs, k))
    agreeing = F.filter(shared, lambda k: F.element_at(entry_pairs, k) == F.element_at(pairs, k))
    contradicted = F.size(agreeing) < F.size(shared)
    forms = lambda a: F.filter(F.transform(a, T.label_form), lambda x: x != "")
    by_label = F.arrays_overlap(forms(entry_labels), forms(labels))
    return F.coalesce(by_id, F.lit(False)) | (~contradicted & ((F.size(agreeing) > 0) | F.coalesce(by_label, F.lit(False))))


def page_entry(entries: DataFrame, keys: Sequence[str], matches: Column) -> DataFrame:
    """The one entry of each page that matches; pages with none or several give no row."""
    hits = entries.where(matches)
    alone = hits.withColumn("_n", F.count("*").over(W.partitionBy(*keys))).where("_n = 1")
    return alone.drop("_n")


def reconcile_rows(rows: DataFrame, group: DataFrame, keys: Sequence[str], url: str) -> DataFrame:
    """Extracted rows (keys, url, place) and a link group (keys, url, place) meet by product key: the group's order first,
    each product's rows in its place, a product the extraction missed as its address alone (added), then rows outside
    the group. Adds product_key, added, rank."""
    first = lambda df, by: df.withColumn("_n", F.row_number().over(W.partitionBy(*keys, by).orderBy("place", url))).where("_n = 1").drop("_n")
    extracted = first(rows.withColumn("product_key", U.product_key(F.col(url))).where("product_key IS NOT NULL"), url)
    wanted = first(group.withColumn("product_key", U.product_key(F.col(url))).where("product_key IS NOT NULL"), "product_key")
    wanted = wanted.select(*keys, "product_key", F.col("place").alias("_group_place"), F.col(url).alias("_group_url"))
    merged = extracted.join(wanted, [*keys, "product_key"], "full")
    merged = merged.withColumn("added", F.col(url).isNull()).withColumn(url, F.coalesce(F.col(url), F.col("_group_url")))
    order = [F.col("_group_place").isNull(), "_group_place", "place", url]
    return merged.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).drop("_group_place", "_group_url")


# Parameters that page a listing, in order of trust; the first four count pages, the others items.
PAGE_STYLE = ["page", "pageNumber", "pageNum", "p"]
PAGERS = [*PAGE_STYLE, "offset", "start", "startIndex", "from", "skip"]


def pager_candidates(endpoints: DataFrame, keys: Sequence[str], page_size: str) -> DataFrame:
    """Numeric pager parameters of recorded addresses with the step they imply first and the other one second: (keys,
    param, start, step, rank). Steps of 0 are none."""
    pairs = endpoints.select(*keys, page_size, F.explode(U.query_pairs(F.col("url"))).alias("p")).select(*keys, page_size, F.col("p.key").alias("param"), F.col("p.value").try_cast("long").alias("start"))
    known = pairs.where(F.col("param").isin(PAGERS) & (F.col("start") >= 0))
    one, size = F.lit(1).cast("long"), F.col(page_size).cast("long")
    implied = F.when(F.col("param").isin(PAGE_STYLE), F.array(one, size)).otherwise(F.array(size, one))
    steps = known.select(*keys, "param", "start", F.posexplode(F.array_distinct(F.filter(implied, lambda s: s > 0))).alias("turn", "step"))
    order = F.row_number().over(W.partitionBy(*keys).orderBy(F.array_position(F.array(*map(F.lit, PAGERS)), F.col("param")), "turn"))
    return steps.withColumn("rank", order).drop("turn")


def probe_url(url: Column, param: Column, value: Column) -> Column:
    """The address with one parameter's value replaced, everything else as it is."""
    return F.regexp_replace(url, F.concat(F.lit(r"([?&]"), param, F.lit("=)[^&#]*")), F.concat(F.lit("$1"), value.cast("string")))


def overlap_share(page1: Column, probe: Column) -> Column:
    """Share of page 1's identifiers that the probe returned again; none for an empty page 1."""
    whole = F.size(F.array_distinct(page1))
    return F.when(whole > 0, F.size(F.array_intersect(page1, probe)) / whole).otherwise(F.lit(0.0))


def page1_shape(urls: DataFrame, keys: Sequence[str], url: str) -> DataFrame:
    """Origins of a listing's first-page addresses and the longest directory that their paths share: the common prefix of
    the smallest and the largest path, cut at its last slash."""
    http = urls.where(F.col(url).rlike("(?i)^https?://"))
    directory = F.regexp_replace(U.path(F.col(url)), "[^/]*$", "")
    stats = http.groupBy(*keys).agg(F.collect_set(F.lower(F.regexp_extract(F.col(url), r"^(https?://[^/?#]+)", 1))).alias("origins"), F.min(directory).alias("_low"), F.max(directory).alias("_high"))
    chars = F.zip_with(F.split("_low", ""), F.split("_high", ""), lambda a, b: F.coalesce(a == b, F.lit(False)))
    shared = F.coalesce(F.nullif(F.array_position(chars, False), F.lit(0)) - 1, F.length("_low"))
    prefix = F.regexp_replace(F.substring(F.col("_low"), F.lit(1), shared.cast("int")), "[^/]*$", "")
    return stats.select(*keys, "origins", prefix.alias("path_prefix"))


def fits_page1(url: Column, origins: Column, path_prefix: Column) -> Column:
    """A response's address is believed if its origin and directory are those that page 1 showed."""
    origin = F.lower(F.regexp_extract(url, r"^(https?://[^/?#]+)", 1))
    return F.coalesce(F.array_contains(origins, origin) & U.path(url).startswith(path_prefix), F.lit(False))


def guarded_rows(rows: DataFrame, shapes: DataFrame, keys: Sequence[str], by: Sequence[str], value: str, base: str, pos: str) -> tuple[DataFrame, DataFrame]:
    """Addresses in the rows of later pages that page 1 lets one believe: (rows, report). ``shapes`` comes from ``page1_shape``
    (keys, origins, path_prefix), ``by`` names the page of a row within its listing. A value must look like an address (a
    slash in it, or an http address) and, joined with ``base``, lie on an origin and in the directory of page 1; in
    listings without a shape none does. Empty and null values count for nothing.

    Rows that may be planned keep their raw value; the report has (keys, by, usable, refused): their number and the
    first value refused, by ``pos`` and then by the value, null if none was. Pages without any value have no row there."""
    told = rows.where(F.col(value) != "").join(shapes.select(*keys, "origins", "path_prefix"), list(keys), "left")
    shaped = F.contains(F.col(value), F.lit("/")) | F.col(value).rlike(r"(?i)^https?:")
    whole = F.when(shaped & F.col("origins").isNotNull(), U.absolute(F.col(value), F.col(base)))
    checked = told.withColumn("_fits", F.coalesce(fits_page1(whole, F.col("origins"), F.col("path_prefix")), F.lit(False)))
    first = F.min(F.when(~F.col("_fits"), F.struct(F.col(pos), F.col(value).alias("raw"))))["raw"]
    report = checked.groupBy(*keys, *by).agg(F.count_if("_fits").alias("usable"), first.alias("refused"))
    return checked.where("_fits").drop("_fits", "origins", "path_prefix"), report


def carried_marks(readings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A mark's value carried from one page to others: per page and field the first filled reading of ranked paths."""
    filled = readings.where(is_filled(F.col("value")))
    return filled.groupBy(*keys, "field").agg(F.min_by(F.struct("value", "path"), "path_rank").alias("b")).select(*keys, "field", "b.*")
