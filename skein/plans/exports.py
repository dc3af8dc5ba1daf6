"""Queries of the export family: variant rows and their shapes, exact lines, names, upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import export as X
from skein.operators import variants as V
from skein.sources.tables import table

#: (order, line number) repeats in lineitem, so line order takes every column that is used.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def _products(spark, folder):
    """Orders as products, their lines as entries; orders without lines have none."""
    entry = F.struct(*LINE_ORDER, F.concat(F.lit("S"), "l_partkey").alias("sku"), F.when(F.col("l_quantity") < 45, F.col("l_returnflag")).alias("flag"))
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    orders = table(spark, folder, "orders").select("o_orderkey", F.concat(F.lit("https://x.example/p/"), "o_orderkey", F.lit("#top")).alias("url"), "o_orderstatus", F.lit("own").alias("flag"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


def _variants(spark, folder):
    return V.explode_variants(_products(spark, folder), "entries", "url", {"sku": "sku", "flag": "flag"}, {"size": "l_quantity"}, sku="sku")


_VARIANTS = """
WITH p AS (SELECT o_orderkey, 'https://x.example/p/' || o_orderkey AS key, o_orderstatus FROM orders),
l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, 'S' || l_partkey, CASE WHEN l_quantity < 45 THEN l_returnflag END NULLS FIRST) - 1 AS pos FROM lineitem),
v AS (SELECT o_orderkey, key, o_orderstatus, pos, CASE WHEN pos IS NOT NULL THEN 'S' || l_partkey END AS sku, CASE WHEN pos IS NULL THEN 'own' WHEN l_quantity < 45 THEN l_returnflag END AS flag,
  CAST(l_quantity AS VARCHAR) AS size, pos IS NOT NULL AND l_quantity >= 45 AS partial FROM p LEFT JOIN l ON l_orderkey = o_orderkey)
"""


def variant_rows(spark, folder):
    rows = _variants(spark, folder)
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.select("o_orderkey", F.coalesce("_variant_pos", F.lit(-1)).cast("long").alias("pos"), "_product_key", blank("_variant_key").alias("_variant_key"), blank("flag").alias("flag"), blank("size").alias("size"), "_variant_partial")


VARIANT_ROWS = _VARIANTS + """SELECT o_orderkey, coalesce(pos, -1) AS pos, key AS _product_key, coalesce(sku, '') AS _variant_key, coalesce(flag, '') AS flag, coalesce(size, '') AS size, partial AS _variant_partial FROM v"""


def variant_summary(spark, folder):
    return V.variant_summary(_variants(spark, folder), ["o_orderstatus"])


VARIANT_SUMMARY = _VARIANTS + """
, q AS (SELECT o_orderstatus, key, count(sku) AS n, bool_or(partial) AS part FROM v GROUP BY 1, 2)
SELECT o_orderstatus, CAST(sum(n) AS BIGINT) AS variants, count(*) AS products, count(*) FILTER (n = 0) AS without_variants, count(*) FILTER (part) AS partial FROM q GROUP BY 1
"""


def nested_rows(spark, folder):
    rows = _variants(spark, folder).withColumn("_pos", F.coalesce("_variant_pos", F.lit(-1)))
    return V.nested_rows(rows, "_product_key", ["_pos"], ["o_orderstatus"], ["size", "flag"]).select("_product_key", "o_orderstatus", "size", "flag", F.col("members").cast("long").alias("members"))


NESTED_ROWS = _VARIANTS + """SELECT key AS _product_key, any_value(o_orderstatus) AS o_orderstatus, string_agg(coalesce(size, ''), '; ' ORDER BY pos) AS size, string_agg(coalesce(flag, ''), '; ' ORDER BY pos) AS flag, count(*) AS members FROM v GROUP BY 1"""


def variant_documents(spark, folder):
    """Nested documents: how many variants each has, and what a product without any carries itself."""
    rows = _variants(spark, folder).withColumn("_pos", F.coalesce("_variant_pos", F.lit(-1)))
    docs = V.variant_documents(rows, "_product_key", ["_pos"], ["o_orderstatus"], ["flag"])
    keys = F.array_join(F.transform("variants", lambda v: v["variant_key"]), ",")
    return docs.select("_product_key", F.coalesce("flag", F.lit("")).alias("own_flag"), F.size("variants").cast("long").alias("variants"), keys.alias("keys"))


VARIANT_DOCUMENTS = _VARIANTS + """SELECT key AS _product_key, coalesce(max(CASE WHEN sku IS NULL THEN flag END), '') AS own_flag, count(sku) AS variants, coalesce(string_agg(sku, ',' ORDER BY pos) FILTER (sku IS NOT NULL), '') AS keys FROM v GROUP BY 1"""


def csv_lines(spark, folder):
    """Customers as exact CSV lines, with commas, quotes and breaks in the names."""
    name = F.when(F.col("c_custkey") % 4 == 0, F.concat("c_name", F.lit(', "Jr"'))).when(F.col("c_custkey") % 4 == 1, F.concat("c_name", F.lit("\n2"))).when(F.col("c_custkey") % 4 == 2, F.col("c_name"))
    rows = table(spark, folder, "customer").select("c_custkey", name.alias("name"), (F.col("c_custkey") % 3 == 0).alias("flag"), F.array("c_mktsegment", F.lit('x"y')).alias("tags"))
    return rows.select("c_custkey", X.csv_line(rows).alias("line"))


CSV_LINES = r'''
SELECT c_custkey, c_custkey || ',' || CASE c_custkey % 4 WHEN 0 THEN '"' || c_name || ', ""Jr"""' WHEN 1 THEN '"' || c_name || chr(10) || '2"' WHEN 2 THEN c_name ELSE '' END || ',' || (c_custkey % 3 = 0)
  || ',"[""' || c_mktsegment || '"",""x\""y""]"' AS line FROM customer
'''


def column_order(spark, folder):
    """Keys of rows beyond the declared ones, by where they are first seen."""
    keys = F.array_compact(F.array(F.lit("id"), F.when(F.col("p_partkey") % 2 == 1, F.lit("odd")), F.when(F.col("p_partkey") % 3 == 2, F.concat(F.lit("b"), F.substring("p_brand", 7, 9))), F.lit("_note")))
    rows = table(spark, folder, "part").select("p_partkey", keys.alias("keys"))
    seen = X.seen_keys(rows, "keys", ["p_partkey"])
    return seen.select("key", F.col("first.p_partkey").alias("first_row"), F.col("first._pos").cast("long").alias("first_pos"))


COLUMN_ORDER = """
WITH k AS (SELECT p_partkey, list_filter(['id', CASE WHEN p_partkey % 2 = 1 THEN 'odd' END, CASE WHEN p_partkey % 3 = 2 THEN 'b' || substr(p_brand, 7, 9) END, '_note'], lambda x: x IS NOT NULL) AS l FROM part),
u AS (SELECT p_partkey, unnest(l) AS key, generate_subscripts(l, 1) - 1 AS pos FROM k)
SELECT key, arg_min(p_partkey, p_partkey * 10 + pos) AS first_row, CAST(arg_min(pos, p_partkey * 10 + pos) AS BIGINT) AS first_pos FROM u GROUP BY 1
"""


def filenames(spark, folder):
    rows = table(spark, folder, "supplier").select("s_suppkey", "s_name")
    name = X.filename(F.col("s_name"), F.lpad(F.col("s_suppkey").cast("string"), 12, "0"), F.lit("2024-05-06").cast("date"), "json", nested=True)
    return rows.select("s_suppkey", name.alias("name"))


FILENAMES = "SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') || '-' || left(lpad(CAST(s_suppkey AS VARCHAR), 12, '0'), 8) || '-2024-05-06-variants-nested.json' AS name FROM supplier"


def upserts(spark, folder):
    """Orders of the first half updated by those of the second at newer versions; equal versions take the change."""
    orders = table(spark, folder, "orders").select("o_custkey", F.col("o_totalprice").alias("total"), F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).alias("version"), "o_orderkey")
    once = orders.groupBy("o_custkey", "version").agg(F.max("total").alias("total"))
    first = lambda df: df.groupBy("o_custkey").agg(F.max_by(F.struct("total", "version"), "version").alias("r")).select("o_custkey", "r.*")
    return X.upsert(first(once.where("version % 2 = 0")), first(once.where("version % 2 = 1")), ["o_custkey"], "version")


UPSERTS = """
WITH o AS (SELECT o_custkey, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS version, max(o_totalprice) AS total FROM orders GROUP BY 1, 2)
SELECT DISTINCT ON (o_custkey) o_custkey, total, CAST(version AS INTEGER) AS version FROM o ORDER BY o_custkey, version DESC
"""


def insert_missing(spark, folder):
    supplier = table(spark, folder, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    more = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return X.insert_missing(supplier, more, ["id"])


INSERT_MISSING = "SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)"


def ordered_snapshot(spark, folder):
    """Rows of each region as one ordered text."""
    nation = table(spark, folder, "nation")
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return nation.groupBy("n_regionkey").agg(F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["n_nationkey"].cast("string"), r["n_name"])), ",").alias("rows"))


ORDERED_SNAPSHOT = "SELECT n_regionkey, string_agg(n_nationkey || ':' || n_name, ',' ORDER BY n_nationkey) AS rows FROM nation GROUP BY 1"


QUERIES = {
    "variant_rows": (variant_rows, VARIANT_ROWS),
    "variant_summary": (variant_summary, VARIANT_SUMMARY),
    "nested_rows": (nested_rows, NESTED_ROWS),
    "variant_documents": (variant_documents, VARIANT_DOCUMENTS),
    "csv_lines": (csv_lines, CSV_LINES),
    "column_order": (column_order, COLUMN_ORDER),
    "filenames": (filenames, FILENAMES),
    "upserts": (upserts, UPSERTS),
    "insert_missing": (insert_missing, INSERT_MISSING),
    "ordered_snapshot": (ordered_snapshot, ORDERED_SNAPSHOT),
}
