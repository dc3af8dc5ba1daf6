"""Queries of the relational family: joins along a spine, usage, latest rows, set operations, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import relational as R
from skein.operators import reports
from skein.operators.ranking import even_sample, proof_triple, top_per
from skein.sources.tables import table


def _spine(spark, folder, *columns):
    """Orders along customer, nation and region, only the wanted columns."""
    orders, customer, nation, region = (table(spark, folder, t) for t in ("orders", "customer", "nation", "region"))
    joined = R.spine(orders, (customer, "o_custkey", "c_custkey"), (nation, "c_nationkey", "n_nationkey"), (region, "n_regionkey", "r_regionkey"))
    return joined.select(*columns)


def usage_by_region_month(spark, folder):
    """Line counts and revenue per region and month: lines are added up per order before they meet the spine."""
    lines = table(spark, folder, "lineitem")
    revenue = (F.col("l_extendedprice").cast("decimal(18,2)") * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(22,4)")
    per_order = lines.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum(revenue).alias("revenue"))
    spine = _spine(spark, folder, "o_orderkey", "o_orderdate", "r_name")
    joined = spine.join(per_order, spine["o_orderkey"] == per_order["l_orderkey"])
    grouped = joined.groupBy(F.col("r_name").alias("region"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return grouped.agg(F.sum("lines").alias("lines"), F.sum("revenue").cast("decimal(28,4)").cast("double").alias("revenue"))


USAGE_BY_REGION_MONTH = """
SELECT r_name AS region, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS lines,
       CAST(sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(22,4))) AS DOUBLE) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2
"""


def usage_by_nation(spark, folder):
    """Several independent facts per nation, zero-filled and rounded: every nation is listed."""
    nation = table(spark, folder, "nation").select("n_nationkey", "n_name")
    start, end = F.lit("1997-03-01").cast("timestamp"), F.lit("1997-04-01").cast("timestamp")
    month = (F.col("o_orderdate") >= start) & (F.col("o_orderdate") < end)
    orders = table(spark, folder, "orders").where(month)
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    spend = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey"))
    by_order = spend.agg(F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spend"))
    suppliers = table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return R.merged_facts(nation, "n_nationkey", [(by_order, "orders", None), (by_order, "spend", 4), (suppliers, "suppliers", None)])


USAGE_BY_NATION = """
WITH m AS (SELECT c_nationkey AS k, count(*) AS orders, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS spend FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-04-01' GROUP BY 1),
s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1)
SELECT n_nationkey, n_name, coalesce(orders, 0) AS orders, floor(CAST(coalesce(spend, 0) AS DOUBLE) * 10000 + 0.5) / 10000 AS spend, coalesce(suppliers, 0) AS suppliers
FROM nation LEFT JOIN m ON n_nationkey = m.k LEFT JOIN s ON n_nationkey = s.k
"""


def left_join_counts(spark, folder):
    return R.counts_with_zero(table(spark, folder, "nation").select("n_nationkey", "n_name"), "n_nationkey", table(spark, folder, "supplier"), "s_nationkey", "suppliers")


LEFT_JOIN_COUNTS = "SELECT n_nationkey, n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2"


def multi_left_join(spark, folder):
    """An activity log with optional subjects: customers of one segment, their large orders, nations of one region."""
    events = table(spark, folder, "events").select("event_id", "user_id")
    people = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name", "c_nationkey")
    nation = table(spark, folder, "nation").where("n_regionkey = 1").select("n_nationkey", "n_name")
    joined = events.join(people, F.col("user_id") == F.col("c_custkey"), "left").join(R.small(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("event_id", "user_id", "c_name", "n_name")


MULTI_LEFT_JOIN = """
SELECT event_id, user_id, c_name, n_name FROM events
LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON user_id = c_custkey
LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON c_nationkey = n_nationkey
"""


def semi_join(spark, folder):
    big = table(spark, folder, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.exists_in(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), big, ["o_orderkey"])


SEMI_JOIN = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 49)"


def anti_join(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.missing_from(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), lines, ["o_orderkey"])


ANTI_JOIN = "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"


def values_join(spark, folder):
    """Join with an inline list: event type to lane, some types without one."""
    lanes = spark.createDataFrame([("purchase", "interactive"), ("signup", "interactive"), ("error", "background")], "event_type string, lane string")
    joined = table(spark, folder, "events").join(R.small(lanes), "event_type", "left")
    return joined.groupBy(F.coalesce("lane", F.lit("none")).alias("lane")).agg(F.count("*").alias("events"))


VALUES_JOIN = """
SELECT coalesce(lane, 'none') AS lane, count(*) AS events FROM events
LEFT JOIN (VALUES ('purchase', 'interactive'), ('signup', 'interactive'), ('error', 'background')) l(t, lane) ON t = event_type GROUP BY 1
"""


def computed_key_join(spark, folder):
    """Join on a key split out of a text: the number in a customer's name is the customer's own key."""
    customer = table(spark, folder, "customer").select(F.split_part("c_name", F.lit("#"), F.lit(2)).cast("long").alias("key"), "c_mktsegment")
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey")
    return orders.join(customer, F.col("o_custkey") == F.col("key")).groupBy("c_mktsegment").agg(F.count("*").alias("orders"), F.max("o_orderkey").alias("last_order"))


COMPUTED_KEY_JOIN = "SELECT c_mktsegment, count(*) AS orders, max(o_orderkey) AS last_order FROM orders JOIN customer ON o_custkey = CAST(split_part(c_name, '#', 2) AS BIGINT) GROUP BY 1"


def first_of_alternatives(spark, folder):
    """The first that is there of: the latest urgent order, the latest order of all, the customer's own key."""
    orders = table(spark, folder, "orders")
    urgent = orders.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("urgent"))
    latest = orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    customer = table(spark, folder, "customer").select("c_custkey")
    joined = customer.join(urgent.withColumnRenamed("o_custkey", "a"), F.col("c_custkey") == F.col("a"), "left").join(latest.withColumnRenamed("o_custkey", "b"), F.col("c_custkey") == F.col("b"), "left")
    return joined.select("c_custkey", F.coalesce("urgent", "latest", "c_custkey").alias("subject"))


FIRST_OF_ALTERNATIVES = """
SELECT c_custkey, coalesce(
  (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1),
  (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1), c_custkey) AS subject FROM customer
"""


def latest_order(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    latest = R.latest_struct(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderdate", "o_totalprice"])
    return latest.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


LATEST_ORDER = """
SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_totalprice FROM orders ORDER BY o_custkey, orders.o_orderdate DESC, o_orderkey DESC
"""


def latest_lookup(spark, folder):
    """Customers with their latest order beside them, by a left join of one row per key."""
    orders = table(spark, folder, "orders")
    latest = R.latest_struct(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus"])
    customer = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return customer.join(latest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_mktsegment", F.col("o_orderstatus").alias("last_status"))


LATEST_LOOKUP = """
SELECT c_custkey, c_mktsegment, o_orderstatus AS last_status FROM customer LEFT JOIN
(SELECT DISTINCT ON (o_custkey) o_custkey, o_orderstatus FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC) ON o_custkey = c_custkey
"""


def self_join_previous(spark, folder):
    """Each event with the value of the user's one before it, as a lag rather than a join of the table with itself."""
    from pyspark.sql import Window as W

    events = table(spark, folder, "events")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select("event_id", "user_id", F.coalesce(F.lag("event_id").over(order), F.lit(-1)).alias("parent_id"), F.lag("value").over(order).alias("parent_value"))


SELF_JOIN_PREVIOUS = "SELECT event_id, user_id, coalesce(lag(event_id) OVER w, -1) AS parent_id, lag(value) OVER w AS parent_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


def distinct_union(spark, folder):
    a = table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation"))
    b = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"))
    return a.union(b).distinct()


DISTINCT_UNION = "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier"


def set_difference(spark, folder):
    """Parts ordered in 1995 but never in 1996, and the overlap's share."""
    lines = table(spark, folder, "lineitem").select("l_partkey", F.year("l_shipdate").alias("y"))
    flags = lines.where("y IN (1995, 1996)").groupBy("l_partkey").agg(F.max(F.col("y") == 1995).alias("a"), F.max(F.col("y") == 1996).alias("b"))
    return flags.agg(F.count_if(F.expr("a AND NOT b")).alias("only_1995"), F.count_if(F.expr("b AND NOT a")).alias("only_1996"), F.count_if(F.expr("a AND b")).alias("both")).withColumn(
        "overlap_share", F.col("both") / F.least(F.col("only_1995") + F.col("both"), F.col("only_1996") + F.col("both"))
    )


SET_DIFFERENCE = """
WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE year(l_shipdate) = 1995), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE year(l_shipdate) = 1996),
n AS (SELECT (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS x, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS y, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS z)
SELECT x AS only_1995, y AS only_1996, z AS both, z / least(x + z, y + z) AS overlap_share FROM n
"""


def project_union(spark, folder):
    """One sheet of two websites' outputs by column name, marked with the website."""
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    supplier = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return R.union_sources([("parts", part), ("suppliers", supplier)])


PROJECT_UNION = """
SELECT 'parts' AS "Website", p_partkey AS id, p_name AS name, p_brand AS brand, CAST(NULL AS DOUBLE) AS balance FROM part
UNION ALL SELECT 'suppliers', s_suppkey, s_name, NULL, s_acctbal FROM supplier
"""


def error_streaks(spark, folder):
    """Three or more errors in a row of one user."""
    events = table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type")
    found = R.streaks(events, "user_id", ["ts", "event_id"], F.col("event_type") == "error", 3)
    return found.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("first", "last")})


ERROR_STREAKS = """
WITH m AS (SELECT user_id, ts, event_type, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS i FROM events)
SELECT user_id, count(*) AS length, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM m WHERE event_type = 'error' GROUP BY user_id, i HAVING count(*) >= 3
"""


def cycle_times(spark, folder):
    timed = R.cycle_times(table(spark, folder, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], "ts")
    return timed.select("event_id", "user_id", F.coalesce(F.floor(F.col("cycle_seconds") * 1000 + 0.5), F.lit(-1)).alias("cycle_ms"))


CYCLE_TIMES = """
SELECT event_id, user_id, coalesce(CAST(floor((epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6) * 1000 + 0.5) AS BIGINT), -1) AS cycle_ms FROM events
"""


def percentiles(spark, folder):
    return R.floor_percentiles(table(spark, folder, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


PERCENTILES = """
WITH l AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS v, count(*) AS n FROM lineitem GROUP BY 1)
SELECT l_returnflag, n, v[1 + least(n - 1, CAST(floor(0.5 * n) AS BIGINT))] AS p50, v[1 + least(n - 1, CAST(floor(0.9 * n) AS BIGINT))] AS p90,
       v[1 + least(n - 1, CAST(floor(0.99 * n) AS BIGINT))] AS p99 FROM l
"""


def even_spread_sample(spark, folder):
    parts = table(spark, folder, "part").select("p_brand", "p_partkey")
    return even_sample(parts, ["p_brand"], ["p_partkey"], 20)


EVEN_SPREAD_SAMPLE = """
WITH p AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT DISTINCT p_brand, p_partkey FROM p, range(20) i(i) WHERE n <= 20 OR pos = (i.i * n) // 20
"""


def top_suppliers(spark, folder):
    """The five suppliers of each part with the largest revenue."""
    lines = table(spark, folder, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("revenue"))
    return top_per(lines, ["l_partkey"], [F.col("revenue").desc(), F.col("l_suppkey")], 5).withColumn("rank", F.col("rank").cast("long"))


TOP_SUPPLIERS = """
WITH s AS (SELECT l_partkey, l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, l_suppkey, revenue, row_number() OVER (PARTITION BY l_partkey ORDER BY revenue DESC, l_suppkey) AS rank FROM s QUALIFY rank <= 5
"""


def proof_products(spark, folder):
    return proof_triple(table(spark, folder, "part"), "p_name", "p_retailprice", "p_partkey")


PROOF_PRODUCTS = """
WITH f AS (SELECT p_partkey AS o, p_name AS n, p_retailprice AS p FROM part ORDER BY p_partkey LIMIT 30),
t AS (SELECT a.o AS first, b.o AS second, c.o AS third, a.p = b.p AND b.p = c.p AS alike FROM f a, f b, f c WHERE a.o < b.o AND b.o < c.o AND a.n <> b.n AND b.n <> c.n AND a.n <> c.n)
SELECT first, second, third FROM t ORDER BY alike, first, second, third LIMIT 1
"""


def run_status(spark, folder):
    """Orders as runs and lines as items: status counts rolled up."""
    status = F.when(F.col("l_linestatus") == "O", F.when(F.col("l_returnflag") == "N", "pending").otherwise("done")).otherwise(F.when(F.col("l_returnflag") == "R", "failed").otherwise("done"))
    items = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("run_id"), status.alias("status"))
    counted = reports.status_counts(items, ["run_id"])
    return counted.withColumn("status", reports.run_status(F.col("run_id") % 7 == 0, F.col("run_id") % 5 == 0, F.lit(False)))


RUN_STATUS = """
WITH i AS (SELECT l_orderkey AS run_id, CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_returnflag = 'N' THEN 'pending' ELSE 'done' END WHEN l_returnflag = 'R' THEN 'failed' ELSE 'done' END AS s FROM lineitem),
c AS (SELECT run_id, count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'running') AS running, count(*) FILTER (s = 'done') AS done, count(*) FILTER (s = 'failed') AS failed FROM i GROUP BY 1)
SELECT *, CASE WHEN pending + running > 0 AND run_id % 7 = 0 THEN 'cancelled' WHEN pending + running > 0 AND run_id % 5 = 0 THEN 'partial' WHEN pending + running > 0 THEN 'extracting'
  WHEN failed = 0 THEN 'completed' WHEN done > 0 THEN 'partial' ELSE 'failed' END AS status FROM c
"""


def cap_states(spark, folder):
    """Customers' spending in one year against a cap of 0, 300,000 or none."""
    spent = table(spark, folder, "orders").where(F.year("o_orderdate") == 1996).groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spent"))
    cap = F.when(F.col("o_custkey") % 3 == 0, F.lit(0.0)).when(F.col("o_custkey") % 3 == 1, F.lit(300_000.0))
    return spent.withColumn("cap", cap).select("o_custkey", "spent", "cap", *reports.cap_state(F.col("cap"), F.col("spent")))


CAP_STATES = """
WITH s AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent, CASE WHEN o_custkey % 3 = 0 THEN 0.0::DOUBLE WHEN o_custkey % 3 = 1 THEN 300000.0::DOUBLE END AS cap
  FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1)
SELECT o_custkey, spent, cap, CASE WHEN cap IS NOT NULL THEN greatest(0.0::DOUBLE, floor((cap - spent) * 10000 + 0.5) / 10000) END AS remaining, coalesce(spent >= cap, false) AS reached,
  CASE WHEN cap = 0 THEN 100.0::DOUBLE ELSE floor(spent / cap * 1000 + 0.5) / 10 END AS percent_used FROM s
"""


def row_total(spark, folder):
    """Rows of array cells added up per run: lines gathered by order, then counted by customer."""
    data = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_quantity")).alias("data"))
    runs = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    joined = runs.join(data, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.groupBy("o_custkey").agg(F.sum(F.coalesce(F.size("data"), F.lit(0)).cast("long")).alias("rows"))


ROW_TOTAL = "SELECT o_custkey, count(l_orderkey) AS rows FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"


QUERIES = {
    "usage_by_region_month": (usage_by_region_month, USAGE_BY_REGION_MONTH),
    "usage_by_nation": (usage_by_nation, USAGE_BY_NATION),
    "left_join_counts": (left_join_counts, LEFT_JOIN_COUNTS),
    "multi_left_join": (multi_left_join, MULTI_LEFT_JOIN),
    "semi_join": (semi_join, SEMI_JOIN),
    "anti_join": (anti_join, ANTI_JOIN),
    "values_join": (values_join, VALUES_JOIN),
    "computed_key_join": (computed_key_join, COMPUTED_KEY_JOIN),
    "first_of_alternatives": (first_of_alternatives, FIRST_OF_ALTERNATIVES),
    "latest_order": (latest_order, LATEST_ORDER),
    "latest_lookup": (latest_lookup, LATEST_LOOKUP),
    "self_join_previous": (self_join_previous, SELF_JOIN_PREVIOUS),
    "distinct_union": (distinct_union, DISTINCT_UNION),
    "set_difference": (set_difference, SET_DIFFERENCE),
    "project_union": (project_union, PROJECT_UNION),
    "error_streaks": (error_streaks, ERROR_STREAKS),
    "cycle_times": (cycle_times, CYCLE_TIMES),
    "percentiles": (percentiles, PERCENTILES),
    "even_spread_sample": (even_spread_sample, EVEN_SPREAD_SAMPLE),
    "top_suppliers": (top_suppliers, TOP_SUPPLIERS),
    "proof_products": (proof_products, PROOF_PRODUCTS),
    "run_status": (run_status, RUN_STATUS),
    "cap_states": (cap_states, CAP_STATES),
    "row_total": (row_total, ROW_TOTAL),
}
