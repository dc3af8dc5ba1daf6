"""Queries of the check family: values, documents, certification, queue rows and shapes, each with a twin that computes
its answer from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import dates as D
from skein.functions import json_leaves as J
from skein.functions import names as N
from skein.functions import redaction
from skein.functions import shape as S
from skein.functions import text as T
from skein.functions import urls as U
from skein.operators import certify as K
from skein.operators import documents as DOC
from skein.operators import export as X
from skein.operators import extract as E
from skein.operators import queue as Q
from skein.operators import relational as R
from skein.operators import reports
from skein.sources.tables import spread, table

NOW = "2024-01-20 00:00:00"


def _pick(values, number):
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def key_sets(spark, folder):
    """Keys of bodies with up to 70 objects in a list, and with empty and null values."""
    items = F.transform(F.sequence(F.lit(1), F.col("event_id") % 70 + 1), lambda i: F.concat(F.lit('{"K'), i.cast("string"), F.lit('":null}')))
    body = F.concat(F.lit('{"items":['), F.array_join(items, ","), F.lit('],"Empty":{},"none":[],"nested":{"Deep":[[{"x":1}]]}}'))
    keys = F.array_sort(J.key_set(F.col("body")))
    return table(spark, folder, "events").select("event_id", body.alias("body")).select("event_id", F.size(keys).cast("long").alias("keys"), F.md5(F.array_join(keys, ",")).alias("digest"))


KEY_SETS = """
WITH k AS (SELECT event_id, list_sort(list_concat(['items', 'empty', 'none', 'nested', 'deep', 'x'], list_transform(range(1, event_id % 70 + 2), lambda i: 'k' || i))) AS keys FROM events)
SELECT event_id, len(keys) AS keys, md5(array_to_string(keys, ',')) AS digest FROM k
"""


def response_groups(spark, folder):
    """Chains of fifty paths, each read from one response with the next."""
    name = lambda n: F.lpad(n.cast("string"), 9, "0")
    custkey = F.col("c_custkey")
    paths = F.when(custkey % 50 == 49, F.array(name(custkey))).otherwise(F.array(name(custkey), name(custkey + 1)))
    reads = table(spark, folder, "customer").select(F.lit("u").alias("url"), custkey.cast("string").alias("response"), F.explode(paths).alias("path"))
    return K.response_groups(reads)


RESPONSE_GROUPS = """
WITH p AS (SELECT c_custkey AS n FROM customer UNION SELECT c_custkey + 1 FROM customer WHERE c_custkey % 50 <> 49), m AS (SELECT min(n) AS low FROM p)
SELECT lpad(CAST(n AS VARCHAR), 9, '0') AS path, lpad(CAST(greatest(n // 50 * 50, low) AS VARCHAR), 9, '0') AS "group" FROM p, m
"""

_NAMES = [
    "auth", "pass", "sig", "dsn", "sessions", "session", "apiKey", "tokenCount", "design", "db_password", "x-api-key", "dedupeKey", "maxTokens", "client.secret",
    "signingKey", "passCount", "author", "cookie", "page", "limit", "jwt", "author_token", "passenger", "connectionString", "compass",
]


def redacted_names(spark, folder):
    """Values behind many names, in three notations: those of secret names are masked."""
    events = table(spark, folder, "events").select("event_id", _pick(_NAMES, F.col("event_id")).alias("name"), F.col("event_id").cast("string").alias("n"))
    notation = F.col("event_id") % 3
    plain = F.when(notation == 0, F.concat(F.lit("at "), "name", F.lit("=v"), "n", F.lit("&page=2"))).when(notation == 1, F.concat(F.lit("at "), "name", F.lit(": v"), "n", F.lit(", page 2")))
    text = plain.otherwise(F.concat(F.lit('{"'), "name", F.lit('": "v '), "n", F.lit('", "page": 2}')))
    return events.select("event_id", redaction.redact_text(text).alias("text"))


REDACTED_NAMES = f"""
WITH e AS (SELECT event_id, {_sql_list(_NAMES)}[1 + CAST(event_id % {len(_NAMES)} AS INTEGER)] AS name FROM events),
w AS (SELECT *, list_transform(regexp_extract_all(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z]+'), lambda x: lower(x)) AS words FROM e),
s AS (SELECT *, NOT (len(words) > 1 AND list_contains({_sql_list(redaction.QUANTITIES)}, words[-1])) AND (list_has_any(words, {_sql_list(redaction.SECRET_WORDS)})
  OR list_has_any(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]), {_sql_list(redaction.SECRET_PAIRS)}) OR regexp_matches(array_to_string(words, ''), '{redaction.SECRET_ENDINGS}')) AS secret FROM w)
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'at ' || name || '=' || CASE WHEN secret THEN '***' ELSE 'v' || event_id END || '&page=2'
  WHEN 1 THEN 'at ' || name || ': ' || CASE WHEN regexp_matches(name, '(?i)(^|[^A-Za-z0-9_])((proxy-)?authorization|(set-)?cookie|x-api-key|api-key)$') THEN '***' WHEN secret THEN '***, page 2' ELSE 'v' || event_id || ', page 2' END
  ELSE '{{"' || name || '": "' || CASE WHEN secret THEN '***' ELSE 'v ' || event_id END || '", "page": 2}}' END AS text FROM s
"""


def month_windows(spark, folder):
    low, high = D.month_bounds("1996-02")
    orders = table(spark, folder, "orders")
    day = F.col("o_orderdate").cast("timestamp")
    return orders.where((day >= low) & (day < high)).select("o_orderkey", D.shift_month(F.date_format("o_orderdate", "yyyy-MM"), 11).alias("later"))


MONTH_WINDOWS = "SELECT o_orderkey, '1997-01' AS later FROM orders WHERE o_orderdate >= TIMESTAMP '1996-02-01' AND o_orderdate < TIMESTAMP '1996-03-01'"


def text_forms(spark, folder):
    """Comparison and stored forms of names with wide letters, a ligature and runs of blanks."""
    raw = F.concat(F.lit("  Ａﬁ "), "c_name", F.lit(" \t\n é  "))
    return table(spark, folder, "customer").select("c_custkey", T.compare_text(raw).alias("compared"), T.stored_text(raw).alias("stored"))


TEXT_FORMS = "SELECT c_custkey, 'Afi ' || c_name || ' é' AS compared, 'Ａﬁ ' || c_name || ' é' AS stored FROM customer"


def amounts(spark, folder):
    """Balances as shown prices, with comma or point before the fraction."""
    shown = F.format_number(F.abs("c_acctbal"), 2)
    swapped = F.translate(shown, ",.", ".,")
    text = F.concat(F.lit("now $"), F.when(F.col("c_custkey") % 2 == 0, shown).otherwise(swapped), F.lit(" only"))
    return table(spark, folder, "customer").select("c_custkey", F.floor(N.amount_of(text) * 100 + 0.5).alias("cents"))


AMOUNTS = "SELECT c_custkey, CAST(floor(abs(c_acctbal) * 100 + 0.5) AS BIGINT) AS cents FROM customer"

_FIELDS = ["List Price", "product_name", "Item Number", "In Stock", "Photo", "Colour Family", "Review Count", "Currency"]


def concepts(spark, folder):
    name = F.concat_ws(" ", _pick(_FIELDS, F.col("p_partkey")), F.when(F.col("p_partkey") % 3 == 0, F.lit("extra")))
    kind = F.when(F.col("p_partkey") % 5 == 0, "money").otherwise("string")
    return table(spark, folder, "part").select("p_partkey", name.alias("name"), kind.alias("kind")).select("p_partkey", N.concept_of(F.col("name"), F.col("kind")).alias("concept"))


CONCEPTS = f"""
WITH n AS (SELECT p_partkey, lower({_sql_list(_FIELDS)}[1 + CAST(p_partkey % {len(_FIELDS)} AS INTEGER)] || CASE WHEN p_partkey % 3 = 0 THEN ' extra' ELSE '' END) AS name, p_partkey % 5 = 0 AS money FROM part),
w AS (SELECT *, trim(regexp_replace(name, '[_-]+', ' ', 'g')) AS words FROM n)
SELECT p_partkey, CASE WHEN regexp_matches(words, '\\b(price|cost)\\b') THEN 'price' WHEN regexp_matches(words, '^(product )?name$') THEN 'product_name' WHEN regexp_matches(words, '\\bphoto\\b') THEN 'image_url'
  WHEN regexp_matches(words, '\\bitem number\\b') THEN 'sku' WHEN regexp_matches(words, '\\bin stock\\b') THEN 'availability' WHEN regexp_matches(words, '\\breview count\\b') THEN 'review_count'
  WHEN regexp_matches(words, '\\bcurrency\\b') THEN 'currency' WHEN money THEN 'price' ELSE regexp_replace(name, '[^a-z0-9]+', '_', 'g') END AS concept FROM w
"""


def refresh_ranges(spark, folder):
    """Whether a run's price may replace the stored one: orders' totals against themselves times 0.9 to 6.3, 0 and below 0."""
    factor = (F.col("o_orderkey") % 9 - 1) * 0.9
    was, now = F.col("o_totalprice").cast("decimal(18,2)"), (F.col("o_totalprice") * factor).cast("decimal(18,2)")
    return table(spark, folder, "orders").select("o_orderkey", S.in_refresh_range("money", "price", now.cast("string"), was.cast("string")).alias("fits"))


REFRESH_RANGES = "SELECT o_orderkey, o_totalprice > 0 AND o_orderkey % 9 - 1 BETWEEN 1 AND 5 AS fits FROM orders"


def object_urls(spark, folder):
    key = _pick(["url", "contentUrl", "@id", "name"], F.col("c_custkey"))
    body = F.concat(F.lit('{"'), key, F.lit('": "https://x.example/'), "c_custkey", F.lit('"}'))
    return table(spark, folder, "customer").select("c_custkey", F.coalesce(J.object_url(body), F.lit("")).alias("url"))


OBJECT_URLS = "SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN '' ELSE 'https://x.example/' || c_custkey END AS url FROM customer"

_HOSTS = ["cdn.segment.com", "segment.com.shop.example", "shop.example", "www.googletagmanager.com", "paypal.com", "notpaypal.com"]


def tracker_requests(spark, folder):
    path = F.when(F.col("event_id") % 7 == 0, "/assets/otFlat.json").otherwise("/api/items")
    url = F.concat(F.lit("https://"), _pick(_HOSTS, F.col("event_id")), path)
    return table(spark, folder, "events").select("event_id", U.is_third_party_noise(url).alias("noise"))


TRACKER_REQUESTS = "SELECT event_id, event_id % 6 IN (0, 3, 4) OR event_id % 7 = 0 AS noise FROM events"

_ANSWERS = ["n/a", "None", " unknown ", "not  found", "nothing", "--", "N/A yet", "0"]


def placeholders(spark, folder):
    return table(spark, folder, "events").select("event_id", redaction.is_placeholder(_pick(_ANSWERS, F.col("event_id"))).alias("none"))


PLACEHOLDERS = "SELECT event_id, event_id % 8 IN (0, 1, 2, 3, 5) AS none FROM events"


def _padded(number):
    """Six digits at least; lpad alone would cut longer numbers."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(6)), F.lit("0"))


def same_pages(spark, folder):
    """Whether an entity describes the page: one of a product type with other identifiers does not."""
    kind = _pick(["Product", "WebPage", "Book"], F.col("p_partkey"))
    other = F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).otherwise(F.col("p_partkey") + 1)
    ids = lambda n: E.identifiers(F.concat(F.lit("Nice item ab"), _padded(n), F.lit(" in blue")))
    return table(spark, folder, "part").select("p_partkey", E.describes_same_page(kind, ids(other), ids(F.col("p_partkey"))).alias("same"))


SAME_PAGES = "SELECT p_partkey, p_partkey % 3 = 1 OR p_partkey % 2 = 0 AS same FROM part"


def _order_leaves(spark, folder):
    """Lines as variants of orders: leaves of a linked-data group."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("price"), "l_returnflag")
    lines = spread(lines, "l_orderkey")
    stem = F.concat(F.lit("hasVariant["), "l_linenumber", F.lit("]."))
    leaf = lambda name, value: F.struct(F.concat(stem, F.lit(name)).alias("path"), value.cast("string").alias("value"))
    return lines.select("l_orderkey", F.explode(F.array(leaf("sku", F.col("l_partkey")), leaf("offers.price", F.col("price")), leaf("color", F.col("l_returnflag")))).alias("l")).select("l_orderkey", "l.*")


def group_variants(spark, folder):
    found = DOC.product_group_variants(_order_leaves(spark, folder), ["l_orderkey"])
    return found.select("l_orderkey", F.col("item").cast("long").alias("item"), "sku", F.floor(F.col("price") * 100 + 0.5).alias("cents"), "color")


GROUP_VARIANTS = """
WITH v AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS item, max(CAST(l_partkey AS VARCHAR)) AS sku, max(CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS VARCHAR)) AS price, max(l_returnflag) AS color FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, item, sku, CAST(floor(CAST(price AS DOUBLE) * 100 + 0.5) AS BIGINT) AS cents, color FROM v
"""


def variant_list_ranks(spark, folder):
    """Lists of variants per order: linked data before a response, longer first."""
    leaves = _order_leaves(spark, folder).withColumn("source", F.lit("json-ld"))
    api = leaves.where("value <> ''").select("l_orderkey", F.regexp_replace("path", "^hasVariant", "skus").alias("path"), "value", F.lit("api").alias("source"))
    found = DOC.variant_lists(leaves.unionByName(api), ["l_orderkey"])
    return found.select("l_orderkey", "source", "list_path", "entries", F.col("rank").cast("long").alias("rank"))


VARIANT_LIST_RANKS = """
WITH n AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS entries FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) >= 2)
SELECT l_orderkey, 'json-ld' AS source, 'hasVariant' AS list_path, entries, 1::BIGINT AS rank FROM n UNION ALL SELECT l_orderkey, 'api', 'skus', entries, 2 FROM n
"""


def resolvable_entries(spark, folder):
    """Catalogue entries whose path is among an order's leaves, or that were used before."""
    orders = table(spark, folder, "orders")
    entries = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.array(*[F.struct(F.lit(p).alias("path"), (F.col("o_orderkey") % 5 == n).alias("used")) for n, p in enumerate(["hasVariant[1].sku", "hasVariant[6].color", "name"])])).alias("e"))
    return DOC.resolvable(entries.select("l_orderkey", "e.*"), _order_leaves(spark, folder), ["l_orderkey"]).select("l_orderkey", "path", "used")


RESOLVABLE_ENTRIES = """
WITH e AS (SELECT o_orderkey, unnest([{'path': 'hasVariant[1].sku', 'used': o_orderkey % 5 = 0, 'line': 1}, {'path': 'hasVariant[6].color', 'used': o_orderkey % 5 = 1, 'line': 6}, {'path': 'name', 'used': o_orderkey % 5 = 2, 'line': -1}]) AS e FROM orders)
SELECT o_orderkey AS l_orderkey, e.path AS path, e.used AS used FROM e WHERE e.used OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = e.line)
"""


def drift_classes(spark, folder):
    """How parts' paths (suppliers) hold on the orders that read them."""
    lines = table(spark, folder, "lineitem")
    flags = lines.select(
        F.col("l_partkey").alias("field"), F.col("l_orderkey").alias("page"), (F.col("l_suppkey") % 7).alias("path"), (F.col("l_suppkey") % 7 == 0).alias("certified_path"), (F.col("l_suppkey") % 3 == 0).alias("fits"),
        (F.col("l_discount") > 0.01).alias("equal"), (F.col("l_quantity") > 4).alias("reads"),
    )
    unread = table(spark, folder, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("field"), F.lit(0).alias("page"))
    return K.drift_class(flags.where("field % 11 <> 0"), unread)


DRIFT_CLASSES = """
WITH p AS (SELECT l_partkey AS field, l_suppkey % 7 AS path, bool_and(l_discount > 0.01) AS eq, bool_and(l_quantity > 4) AS rd, bool_or(l_suppkey % 7 = 0) AS own, bool_or(l_suppkey % 3 = 0) AS fits, count(*) AS n FROM lineitem WHERE l_partkey % 11 <> 0 GROUP BY 1, 2)
SELECT p_partkey AS field, 'not-checked' AS drift FROM part WHERE p_partkey % 2 = 0 AND p_partkey NOT IN (SELECT field FROM p) UNION ALL
SELECT field, CASE WHEN bool_or(own AND eq) THEN 'other-layout' WHEN bool_or(NOT own AND eq AND n >= 2) THEN 'moved' WHEN bool_or((own OR fits) AND rd) THEN 'changed' ELSE 'lost' END AS drift FROM p GROUP BY 1
"""


def refresh_plans(spark, folder):
    """Whether parts' prices on all their orders may be refreshed, else the first reason why not."""
    lines = table(spark, folder, "lineitem")
    price = F.col("l_extendedprice").cast("string")
    pages = lines.select(
        F.col("l_partkey").alias("field"), F.col("l_orderkey").alias("url"), price.alias("was"), F.when(F.col("l_quantity") == 3, F.lit("")).when(F.col("l_linenumber") == 1, F.lit("1")).otherwise(price).alias("now"),
        (F.col("l_partkey") % 11 != 0).alias("by_nature"), (F.col("l_linenumber") < 7).alias("same_place"), (F.col("l_discount") == 0.0).alias("fixed_variant"), (F.col("l_tax") < 0.08).alias("shown"), (F.col("l_quantity") < 50).alias("in_range"),
    )
    return K.refresh_plan(pages).select("field", F.coalesce("refusal", F.lit("")).alias("refusal"), "changed")


REFRESH_PLANS = """
WITH s AS (SELECT l_partkey AS field, count(*) AS n, l_partkey % 11 <> 0 AS nature, bool_or(l_quantity = 3) AS empty, bool_and(l_linenumber < 7) AS place, bool_or(l_discount = 0.0) AS fixed, bool_and(l_tax < 0.08) AS shown, bool_and(l_quantity < 50) AS rng,
  count(*) FILTER (l_quantity = 3 OR l_linenumber = 1) AS changed FROM lineitem GROUP BY l_partkey)
SELECT field, CASE WHEN NOT nature THEN 'not-by-nature' WHEN n < 2 THEN 'too-few-pages' WHEN empty THEN 'empty' WHEN NOT place THEN 'not-same-place' WHEN fixed THEN 'fixed-variant' WHEN NOT shown THEN 'not-shown' WHEN NOT rng THEN 'out-of-range' ELSE '' END AS refusal, changed FROM s
"""


def field_currency(spark, folder):
    """Customers' newest clean check of each status against today's definition."""
    orders = table(spark, folder, "orders")
    results = orders.select(
        F.col("o_custkey").alias("source"), F.col("o_orderstatus").alias("field"), F.lit("completed").alias("status"), F.when(F.col("o_orderkey") % 6 == 0, F.lit("failed")).alias("error"), F.col("o_orderdate").alias("completed_at"),
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 2).cast("string").alias("field_hash"), (F.col("o_orderkey") % 3 != 0).alias("passes"), (F.col("o_orderkey") % 5 % 2).cast("string").alias("hold_hash"),
    )
    hashes = orders.select(F.col("o_custkey").alias("source"), F.col("o_orderstatus").alias("field")).distinct().withColumn("hash", F.lit("1"))
    return K.currency(results, hashes, "source")


FIELD_CURRENCY = """
WITH n AS (SELECT DISTINCT ON (o_custkey, o_orderstatus) * FROM orders WHERE o_orderkey % 6 <> 0 ORDER BY o_custkey, o_orderstatus, o_orderdate DESC, o_orderkey DESC)
SELECT o_custkey AS source, o_orderstatus AS field, CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 3 <> 0 THEN 'current' WHEN o_orderkey % 5 % 2 = 1 THEN 'held' ELSE 'stale' END AS state FROM n
"""


def lean_runs(spark, folder):
    """Runs (customers) over their orders, read both ways: where they have switched to full pages."""
    orders = table(spark, folder, "orders")
    lean = F.when(F.col("o_orderkey") % 4 != 0, F.when(F.col("o_orderkey") % 31 == 0, F.lit("other")).otherwise(F.lit("v")))
    readings = orders.select(F.col("o_custkey").alias("run"), "o_orderdate", "o_orderkey", lean.alias("lean"), F.lit("v").alias("full"))
    return K.lean_agreement(readings, "run", ["o_orderdate", "o_orderkey"], streak=2).select("run", "o_orderkey", "disagreed", "rescued", "full_mode")


LEAN_RUNS = """
WITH f AS (SELECT o_custkey AS run, o_orderkey, o_orderdate, o_orderkey % 4 <> 0 AND o_orderkey % 31 = 0 AS disagreed, o_orderkey % 4 = 0 AS rescued FROM orders),
r AS (SELECT *, coalesce(rescued AND lag(rescued) OVER w, false) AS twice FROM f WINDOW w AS (PARTITION BY run ORDER BY o_orderdate, o_orderkey))
SELECT run, o_orderkey, disagreed, rescued, bool_or(disagreed OR twice) OVER (PARTITION BY run ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS full_mode FROM r
"""


def redacted_lines(spark, folder):
    """Log lines of every kind that can carry a secret, and two that only look like it, made of customers' keys and names."""
    n = F.col("c_custkey").cast("string")
    said = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    lines = [
        said("authorization: bearer t", n), said("GET http://u", n, ":p/", n, "@h:1/x"), said("dial joe", n, ":hunter2@db.example:5432 from ", F.col("c_name")), said("GET /a?key=k", n, "&b=", n),
        said("Cookie: sid=s", n, "; other=d", n, "\nnext ", n), said('{"apiKey": "v', n, '", "n": ', n, "}"), said("proxy host:8080/path", n, "?e=a@b"), said("to=https%3A%2F%2Fu:p", n, "%40h&n=", n),
        said("seen ", F.col("c_name"), "\n  params: ", n, ",", F.col("c_name")), said("bought by ", F.col("c_name"), " for ", n), said("redis://:pw", n, "@cache/0 x-api-key: k", n), said("DB_PASSWORD=s", n, " count=", n),
    ]
    line = F.element_at(F.array(*lines), (F.col("c_custkey") % len(lines) + 1).cast("int"))
    return table(spark, folder, "customer").select("c_custkey", redaction.redact_text(line).alias("line"))


REDACTED_LINES = """
SELECT c_custkey, CASE c_custkey % 12 WHEN 0 THEN 'authorization: bearer ***' WHEN 1 THEN 'GET http://***@h:1/x' WHEN 2 THEN 'dial ***@db.example:5432 from ' || c_name WHEN 3 THEN 'GET /a?key=***&b=' || c_custkey
  WHEN 4 THEN 'Cookie: ***' || chr(10) || 'next ' || c_custkey WHEN 5 THEN '{"apiKey": "***", "n": ' || c_custkey || '}' WHEN 6 THEN 'proxy host:8080/path' || c_custkey || '?e=a@b' WHEN 7 THEN 'to=https%3A%2F%2F***%40h&n=' || c_custkey
  WHEN 8 THEN 'seen ' || c_name || chr(10) || '  params: ***' WHEN 9 THEN 'bought by ' || c_name || ' for ' || c_custkey WHEN 10 THEN 'redis://***@cache/0 x-api-key: ***' ELSE 'DB_PASSWORD=*** count=' || c_custkey END AS line FROM customer
"""


def stale_runs(spark, folder):
    """Events as run items, one in three running since its time."""
    now = F.lit(NOW).cast("timestamp")
    items = table(spark, folder, "events").select("event_id", _pick(["running", "pending", "done"], F.col("event_id")).alias("status"), F.col("ts").cast("timestamp").alias("started_at"))
    return Q.stale_runs(items, now, 60).groupBy("status").agg(F.count("*").alias("items"))


STALE_RUNS = """
SELECT CASE WHEN event_id % 3 = 2 THEN 'done' WHEN event_id % 3 = 0 AND NOT ts < TIMESTAMP '2024-01-20' - INTERVAL 60 MINUTE THEN 'running' ELSE 'pending' END AS status, count(*) AS items FROM events GROUP BY 1
"""


def closed_rows(spark, folder):
    """Rows of dead jobs (users with a high error) that were still going are failed."""
    events = table(spark, folder, "events")
    rows = events.select("event_id", F.col("user_id").alias("job_id"), _pick(["running", "done", "planning"], F.col("event_id")).alias("status"), F.lit(None).cast("string").alias("error"))
    dead = events.where("event_type = 'error' and value > 50").groupBy(F.col("user_id").alias("id")).agg(F.concat(F.lit("lost after "), F.max("event_id")).alias("error"))
    closed = Q.closed_rows(rows, dead)
    return closed.select("event_id", "status", F.coalesce("error", F.lit("")).alias("error"))


CLOSED_ROWS = """
WITH d AS (SELECT user_id, 'lost after ' || max(event_id) AS error FROM events WHERE event_type = 'error' AND value > 50 GROUP BY 1), r AS (SELECT event_id, user_id, ['running', 'done', 'planning'][1 + CAST(event_id % 3 AS INTEGER)] AS status FROM events)
SELECT event_id, CASE WHEN d.user_id IS NOT NULL AND status <> 'done' THEN 'failed' ELSE status END AS status, CASE WHEN d.user_id IS NOT NULL AND status <> 'done' THEN d.error ELSE '' END AS error FROM r LEFT JOIN d USING (user_id)
"""


def rekeyed(spark, folder):
    """Columns under display names, of which two are equal; undeclared ones go."""
    return X.rekey(table(spark, folder, "supplier"), {"s_suppkey": "id", "s_name": "Name", "s_nationkey": "id"})


REKEYED = 'SELECT s_suppkey AS id, s_name AS "Name", s_nationkey AS "id (2)" FROM supplier'


def merged_rows(spark, folder):
    """One row from the input, the listing and the detail page."""
    joined = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    of = lambda *columns: F.struct(*columns)
    origins = {"name": ("detail", "c_name"), "where": ("listing", "n_name"), "key": ("input", "c_custkey")}
    merged = X.merge_row(of("c_custkey"), of("n_name"), of("c_name", "c_acctbal"), F.concat(F.lit("https://x.example/"), "c_custkey"), F.lit(1), origins)
    return joined.select(*merged).withColumnRenamed("_page_number", "page").withColumnRenamed("_url", "url")


MERGED_ROWS = "SELECT c_name AS name, n_name AS \"where\", c_custkey AS \"key\", 'https://x.example/' || c_custkey AS url, 1 AS page FROM customer JOIN nation ON c_nationkey = n_nationkey"


def representatives(spark, folder):
    """The first part of the most common type and size."""
    parts = table(spark, folder, "part").select(F.concat_ws(" ", "p_type", "p_size").alias("shape"), "p_partkey", "p_name")
    return reports.representative(parts, "shape", "p_partkey", "p_name").select("shape", "pages", "p_name")


REPRESENTATIVES = "SELECT p_type || ' ' || p_size AS shape, count(*) AS pages, arg_min(p_name, p_partkey) AS p_name FROM part GROUP BY 1 ORDER BY count(*) DESC, min(p_partkey) LIMIT 1"


def agreed_values(spark, folder):
    """Per order and flag the value that the best-ranked line reads, and how many lines agree."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_linenumber").agg(F.max("l_linestatus").alias("s"), F.max("l_quantity").alias("q"))
    candidates = lines.select("l_orderkey", F.col("l_returnflag").alias("field"), F.col("l_linenumber").alias("rank"), F.concat_ws("", "s", (F.col("q") % 2).cast("int")).alias("value"), F.lit(0.75).alias("confidence"))
    return E.agreement_confidence(candidates, ["l_orderkey"]).select("l_orderkey", "field", "value", F.floor(F.col("confidence") * 1000 + 0.5).alias("confidence_e3"))


AGREED_VALUES = """
WITH c AS (SELECT l_orderkey, l_returnflag AS field, l_linenumber AS rank, max(l_linestatus) || CAST(CAST(max(l_quantity) AS BIGINT) % 2 AS VARCHAR) AS value FROM lineitem GROUP BY 1, 2, 3),
b AS (SELECT l_orderkey, field, arg_min(value, rank) AS value, count(*) AS n FROM c GROUP BY 1, 2)
SELECT l_orderkey, field, b.value AS value, CASE WHEN n = 1 THEN 750 ELSE CAST(floor(1000.0::DOUBLE * (SELECT count(*) FROM c WHERE c.l_orderkey = b.l_orderkey AND c.field = b.field AND lower(c.value) = lower(b.value)) / n + 0.5) AS BIGINT) END AS confidence_e3 FROM b
"""


def resolved_fields(spark, folder):
    """Flags A, N and R wanted of every order: the status that its lines agree on, or that no line gave one."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_linenumber").agg(F.max("l_linestatus").alias("s"))
    status = F.when(F.col("l_linenumber") != 2, F.col("s"))
    candidates = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("field"), F.col("l_linenumber").alias("rank"), status.alias("value"), F.lit(0.5).alias("confidence"))
    wanted = table(spark, folder, "orders").select("o_orderkey", F.explode(F.array(*map(F.lit, "ANR"))).alias("field"))
    return E.resolved_fields(candidates, wanted, ["o_orderkey"]).select("o_orderkey", "field", F.coalesce("value", F.lit("")).alias("value"), "failed")


RESOLVED_FIELDS = """
WITH c AS (SELECT l_orderkey, l_returnflag, arg_min(s, n) AS value FROM (SELECT l_orderkey, l_returnflag, l_linenumber AS n, max(l_linestatus) AS s FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1, 2, 3) GROUP BY 1, 2),
w AS (SELECT o_orderkey, unnest(['A', 'N', 'R']) AS field FROM orders)
SELECT o_orderkey, field, coalesce(value, '') AS value, value IS NULL AS failed FROM w LEFT JOIN c ON o_orderkey = l_orderkey AND field = l_returnflag
"""


def usage_growth(spark, folder):
    """Lines as a ledger of tokens per supplier: what the later half of the order numbers added."""
    lines = table(spark, folder, "lineitem")
    sums = [F.sum(F.col(c).cast("long")).alias(n) for c, n in (("l_quantity", "input"), ("l_linenumber", "output"), ("l_suppkey", "cache_write"), ("l_partkey", "cache_read"))]
    ledger = lambda rows: rows.groupBy(F.col("l_suppkey").alias("model")).agg(*sums, F.count("*").alias("requests"))
    return reports.usage_difference(ledger(lines.where("l_orderkey % 8 < 4 and l_suppkey % 3 <> 0")), ledger(lines.where("l_suppkey % 3 = 0 or l_suppkey % 5 <> 0 or l_orderkey % 8 < 4")))


USAGE_GROWTH = """
WITH l AS (SELECT l_suppkey AS model, CAST(l_quantity AS BIGINT) AS q, l_linenumber AS n, l_suppkey AS s, l_partkey AS p, l_orderkey % 8 < 4 AND l_suppkey % 3 <> 0 AS early FROM lineitem WHERE l_suppkey % 3 = 0 OR l_suppkey % 5 <> 0 OR l_orderkey % 8 < 4)
SELECT model, CAST(sum(q) AS BIGINT) AS input, CAST(sum(n) AS BIGINT) AS output, CAST(sum(s) AS BIGINT) AS cache_write, CAST(sum(p) AS BIGINT) AS cache_read, count(*) AS requests FROM l WHERE NOT early GROUP BY 1
"""


def summed_counts(spark, folder):
    """Counts of events by type, kept as a map per user and day, added up per user."""
    daily = table(spark, folder, "events").groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    maps = daily.groupBy("user_id", "day").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("counts"))
    text = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return R.sum_maps(maps, ["user_id"], "counts").select("user_id", text.alias("counts"))


SUMMED_COUNTS = """
WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM n GROUP BY 1
"""


def merged_settings(spark, folder):
    """Settings of customers over those of their segment: the customer's own stand."""
    default = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("limit"), F.lit("10"))
    own = F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("limit"), F.col("c_custkey").cast("string"))).when(F.col("c_custkey") % 3 == 1, F.create_map(F.lit("note"), F.lit(None).cast("string")))
    merged = table(spark, folder, "customer").select("c_custkey", R.merge_maps(default, own).alias("m"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-")))), ",")
    return merged.select("c_custkey", text.alias("settings"))


MERGED_SETTINGS = """
SELECT c_custkey, 'limit=' || CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '10' END || CASE WHEN c_custkey % 3 = 1 THEN ',note=-' ELSE '' END || ',segment=' || c_mktsegment AS settings FROM customer
"""


def concatenated_rows(spark, folder):
    """Lines of orders as arrays, one after another per customer in order of date."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("rows"))
    orders = table(spark, folder, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    joined = R.concatenated(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "rows")
    return joined.select("o_custkey", "item", F.col("value.l_partkey").alias("l_partkey"))


CONCATENATED_ROWS = """
SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, l_linenumber, l_partkey) - 1 AS item, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey
"""


QUERIES = {
    "key_sets": (key_sets, KEY_SETS),
    "response_groups": (response_groups, RESPONSE_GROUPS),
    "redacted_names": (redacted_names, REDACTED_NAMES),
    "month_windows": (month_windows, MONTH_WINDOWS),
    "text_forms": (text_forms, TEXT_FORMS),
    "amounts": (amounts, AMOUNTS),
    "concepts": (concepts, CONCEPTS),
    "refresh_ranges": (refresh_ranges, REFRESH_RANGES),
    "object_urls": (object_urls, OBJECT_URLS),
    "tracker_requests": (tracker_requests, TRACKER_REQUESTS),
    "placeholders": (placeholders, PLACEHOLDERS),
    "same_pages": (same_pages, SAME_PAGES),
    "group_variants": (group_variants, GROUP_VARIANTS),
    "variant_list_ranks": (variant_list_ranks, VARIANT_LIST_RANKS),
    "resolvable_entries": (resolvable_entries, RESOLVABLE_ENTRIES),
    "drift_classes": (drift_classes, DRIFT_CLASSES),
    "refresh_plans": (refresh_plans, REFRESH_PLANS),
    "field_currency": (field_currency, FIELD_CURRENCY),
    "lean_runs": (lean_runs, LEAN_RUNS),
    "redacted_lines": (redacted_lines, REDACTED_LINES),
    "stale_runs": (stale_runs, STALE_RUNS),
    "closed_rows": (closed_rows, CLOSED_ROWS),
    "rekeyed": (rekeyed, REKEYED),
    "merged_rows": (merged_rows, MERGED_ROWS),
    "representatives": (representatives, REPRESENTATIVES),
    "agreed_values": (agreed_values, AGREED_VALUES),
    "resolved_fields": (resolved_fields, RESOLVED_FIELDS),
    "usage_growth": (usage_growth, USAGE_GROWTH),
    "summed_counts": (summed_counts, SUMMED_COUNTS),
    "merged_settings": (merged_settings, MERGED_SETTINGS),
    "concatenated_rows": (concatenated_rows, CONCATENATED_ROWS),
}
