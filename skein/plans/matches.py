"""Queries of the matching family: first hits, leaves, redaction, reconciliation, page-1 shapes, explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import html as H
from skein.functions import json_leaves as J
from skein.functions import numbers as N
from skein.functions import redaction
from skein.functions import urls as U
from skein.operators import matching as M
from skein.operators import reports
from skein.sources.tables import spread, table


def first_hits(spark, folder):
    """The first body of each user's events in which a path leads somewhere."""
    events = table(spark, folder, "events")
    body = F.when(F.col("event_type") == "error", F.lit('{"k": ""}')).otherwise(F.col("props"))
    bodies = events.select("user_id", F.col("event_id").alias("seq"), F.concat(F.lit("https://x.example/e/"), "event_id", F.lit("?q=1")).alias("url"), body.alias("body"))
    return M.first_hit(bodies, ["k", "none"], ["user_id"])


FIRST_HITS = """
SELECT user_id, 'k' AS path, arg_min(json_extract_string(props, '$.k'), event_id) AS value, 'https://x.example/e/' || min(event_id) AS response FROM events WHERE event_type <> 'error' GROUP BY 1
"""


def leaf_rows(spark, folder):
    """Leaves of a document made of each nation's suppliers: paths, depths and values."""
    supplier = table(spark, folder, "supplier")
    items = F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name")))
    body = F.to_json(F.struct(F.lit(1).alias("v"), F.transform(items, lambda s: F.struct(s["s_suppkey"].alias("id"), s["s_name"].alias("name"))).alias("items")))
    docs = supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(body.alias("body"))
    return J.leaf_table(docs, ["nation"], "body", J.FLATTEN).select("nation", F.col("pos").cast("long").alias("pos"), "path", F.col("depth").cast("long").alias("depth"), "value")


LEAF_ROWS = """
WITH s AS (SELECT s_nationkey AS nation, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier), f AS (SELECT * FROM s WHERE i < 3)
SELECT DISTINCT nation, CAST(0 AS BIGINT) AS pos, 'v' AS path, CAST(1 AS BIGINT) AS depth, '1' AS value FROM s
UNION ALL SELECT nation, 1 + 2 * i, 'items[' || i || '].id', 3, CAST(s_suppkey AS VARCHAR) FROM f UNION ALL SELECT nation, 2 + 2 * i, 'items[' || i || '].name', 3, s_name FROM f
"""


def redacted(spark, folder):
    text = F.concat(F.lit("GET https://u"), "c_custkey", F.lit(":pw@shop.example/a?token=t"), "c_custkey", F.lit("&page=2 by "), "c_name")
    rows = spread(table(spark, folder, "customer"), "c_custkey").select("c_custkey", text.alias("text"))
    return rows.select("c_custkey", redaction.redact_text(F.col("text")).alias("text"))


REDACTED = "SELECT c_custkey, 'GET https://***@shop.example/a?token=***&page=2 by ' || c_name AS text FROM customer"


def secret_keys(spark, folder):
    """Names made of part words: which name a secret."""
    suffix = F.element_at(F.array(*[F.lit(s) for s in ("Token", "Count", "_api_key", "TokenCount", "Design")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    key = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), suffix)
    return table(spark, folder, "part").select("p_partkey", key.alias("key"), redaction.is_secret_key(key).alias("secret"))


SECRET_KEYS = """
SELECT p_partkey, replace(p_name, ' ', '') || ['Token', 'Count', '_api_key', 'TokenCount', 'Design'][1 + p_partkey % 5] AS key, p_partkey % 5 IN (0, 2) AS secret FROM part
"""


def reconciled(spark, folder):
    """Pages extracted of a root domain against all its pages as the group: what was missed comes in at its place."""
    pages = table(spark, folder, "pages").select(U.root_domain(U.host(F.col("url"))).alias("root"), "url", F.col("page_id").alias("place"))
    rows = M.reconcile_rows(pages.where("place % 3 = 0"), pages, ["root"], "url")
    return rows.select("root", "product_key", "added").distinct()


RECONCILED = """
WITH p AS (SELECT array_to_string(string_split(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '.')[-2:], '.') AS root, page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\\.', '') || rtrim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/') AS product_key FROM pages)
SELECT root, product_key, bool_and(page_id % 3 <> 0) AS added FROM p GROUP BY 1, 2
"""


def first_page_shapes(spark, folder):
    pages = table(spark, folder, "pages").select(U.root_domain(U.host(F.col("url"))).alias("root"), "url")
    shape = M.page1_shape(pages, ["root"], "url")
    return shape.select("root", F.size("origins").cast("long").alias("origins"), "path_prefix")


FIRST_PAGE_SHAPES = r"""
WITH p AS (SELECT array_to_string(string_split(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '.')[-2:], '.') AS root, lower(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)) AS origin, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '[^/]*$', '') AS dir FROM pages)
SELECT root, count(DISTINCT origin) AS origins, CASE WHEN count(DISTINCT dir) = 1 THEN min(dir) ELSE '/' END AS path_prefix FROM p GROUP BY 1
"""


def pagers(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("?offset=30&page=2&q=x")).alias("url"), F.lit(30).alias("n"))
    return M.pager_candidates(pages, ["page_id"], "n").select("page_id", "param", "start", "step", F.col("rank").cast("long").alias("rank"))


PAGERS = """
SELECT page_id, t[1] AS param, CAST(t[2] AS BIGINT) AS start, CAST(t[3] AS BIGINT) AS step, CAST(t[4] AS BIGINT) AS rank FROM (SELECT page_id, unnest([('page', 2, 1, 1), ('page', 2, 30, 2), ('offset', 30, 30, 3), ('offset', 30, 1, 4)]) AS t FROM pages)
"""


def overlaps(spark, folder):
    """Share of a customer's first-year parts that come back in the next year."""
    lines = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey", F.year("l_shipdate").alias("y")).where("y IN (1996, 1997)")
    sets = lines.groupBy("l_suppkey").agg(F.collect_set(F.when(F.col("y") == 1996, F.col("l_partkey"))).alias("a"), F.collect_set(F.when(F.col("y") == 1997, F.col("l_partkey"))).alias("b"))
    return sets.select("l_suppkey", M.overlap_share(F.col("a"), F.col("b")).alias("share"))


OVERLAPS = """
WITH d AS (SELECT DISTINCT l_suppkey, l_partkey, year(l_shipdate) AS y FROM lineitem WHERE year(l_shipdate) IN (1996, 1997)), a AS (SELECT l_suppkey, l_partkey, bool_or(y = 1996) AS x, bool_or(y = 1997) AS z FROM d GROUP BY 1, 2)
SELECT l_suppkey, CASE WHEN count(*) FILTER (x) > 0 THEN count(*) FILTER (x AND z) / count(*) FILTER (x) ELSE 0.0::DOUBLE END AS share FROM a GROUP BY 1
"""


def shown_numbers(spark, folder):
    """Prices written in a sentence: shown on their own, or only as a part of a longer number."""
    parts = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("now "), F.format_number("p_retailprice", 2), F.lit(" only"))).otherwise(F.concat(F.lit("no. 9"), F.format_string("%.2f", "p_retailprice"), F.lit("7x")))
    return parts.select("p_partkey", N.number_shown(F.col("p_retailprice"), text).alias("shown"))


SHOWN_NUMBERS = "SELECT p_partkey, p_partkey % 2 = 0 AS shown FROM part"


def costs(spark, folder):
    """Token costs by model, one of them unknown."""
    usage = table(spark, folder, "events").select(F.col("event_type").alias("model"), F.col("event_id").alias("input"), F.lit(10).alias("output"), F.lit(4).alias("cache_write"), F.lit(10).alias("cache_read"))
    prices = spark.createDataFrame([("view", 3.0, 15.0), ("click", 1.0, 5.0), ("purchase", 0.5, 2.0), ("signup", 3.0, 15.0)], "model string, input_price double, output_price double")
    cost = reports.cost_usd(usage, prices)
    return cost.groupBy("model").agg(F.floor(F.sum("cost_usd").cast("decimal(18,6)").cast("double") * 1e4 + 0.5).alias("cost_e4"), F.max("known").alias("known"))


COSTS = """
WITH p AS (SELECT * FROM (VALUES ('view', 3.0::DOUBLE, 15.0::DOUBLE), ('click', 1.0, 5.0), ('purchase', 0.5, 2.0), ('signup', 3.0, 15.0)) v(m, i, o))
SELECT event_type AS model, CAST(floor(CAST(CAST(coalesce(sum(((event_id + 1.25 * 4 + 0.1 * 10) * i + 10 * o) / 1e6), 0) AS DECIMAL(18,6)) AS DOUBLE) * 1e4 + 0.5) AS BIGINT) AS cost_e4, bool_or(i IS NOT NULL) AS known FROM events LEFT JOIN p ON m = event_type GROUP BY 1
"""


def volatile_paths(spark, folder):
    """Paths made of part words: which will not survive a site's next build, and which quote their value."""
    path = F.concat(F.lit('//div[@class="'), F.when(F.col("p_partkey") % 3 == 0, F.lit("css-1x2y3z")).otherwise(F.split_part("p_name", F.lit(" "), F.lit(1))), F.lit('"]/p'))
    return table(spark, folder, "part").select("p_partkey", H.looks_volatile(path).alias("volatile"), H.xpath_contains_value(path, F.split_part("p_name", F.lit(" "), F.lit(1))).alias("quotes"))


VOLATILE_PATHS = "SELECT p_partkey, p_partkey % 3 = 0 AS volatile, p_partkey % 3 <> 0 AS quotes FROM part"


QUERIES = {
    "first_hits": (first_hits, FIRST_HITS),
    "leaf_rows": (leaf_rows, LEAF_ROWS),
    "redacted": (redacted, REDACTED),
    "secret_keys": (secret_keys, SECRET_KEYS),
    "reconciled": (reconciled, RECONCILED),
    "first_page_shapes": (first_page_shapes, FIRST_PAGE_SHAPES),
    "pagers": (pagers, PAGERS),
    "overlaps": (overlaps, OVERLAPS),
    "shown_numbers": (shown_numbers, SHOWN_NUMBERS),
    "costs": (costs, COSTS),
    "volatile_paths": (volatile_paths, VOLATILE_PATHS),
}
