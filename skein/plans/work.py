"""Queries of the work family: ranked paths, queues, rate limits, extraction stores and certification."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import certify as K
from skein.operators import extract as E
from skein.operators import lean as LEAN
from skein.operators import queue as Q
from skein.operators import ranking as R
from skein.operators import reports
from skein.functions.json_leaves import by_path, stable_json
from skein.sources.tables import spread, table

NOW = "2024-01-20 00:00:00"


def _paths(spark, folder):
    """Supplier-part pairs as stored paths: parts are fields, suppliers paths."""
    lines = spread(table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_discount"), "l_partkey")
    grouped = lines.groupBy("l_partkey", "l_suppkey").agg(F.count_if(F.col("l_discount") > 0.04).alias("hits"), F.count_if(F.col("l_discount") <= 0.04).alias("misses"))
    names = F.array(*[F.lit(s) for s in ("api", "json-ld", "meta", "xpath", "human")])
    source = F.element_at(names, (F.col("l_suppkey") % 5 + 1).cast("int"))
    return grouped.select(
        F.col("l_partkey").alias("field"), source.alias("source"), source.alias("origin"), F.concat(F.lit("p"), "l_suppkey").alias("path"), "hits", "misses", (F.col("l_suppkey") % 7 == 0).alias("pinned"),
        F.lit(0.5).alias("confidence"), F.when(F.col("l_suppkey") % 2 == 0, F.lit("2024-01-15")).otherwise(F.lit("2023-01-01")).cast("timestamp").alias("last_used_at"), F.col("l_suppkey").alias("place"),
    )


_PATHS = """
WITH g AS (SELECT l_partkey AS field, l_suppkey AS place, count(*) FILTER (l_discount > 0.04) AS hits, count(*) FILTER (l_discount <= 0.04) AS misses FROM lineitem GROUP BY 1, 2),
p AS (SELECT *, ['api', 'json-ld', 'meta', 'xpath', 'human'][1 + place % 5] AS source, 'p' || place AS path, place % 7 = 0 AS pinned,
  CASE WHEN misses = 0 THEN 1.0::DOUBLE ELSE hits / (hits + misses * CASE WHEN place % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5 END) END AS score FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY pinned DESC, source = 'human' DESC, round(score, 9) DESC, CASE source WHEN 'human' THEN 100 WHEN 'json-ld' THEN 80 WHEN 'meta' THEN 70 WHEN 'xpath' THEN 60 ELSE 40 END DESC, place) AS rank FROM p)
"""


def ranked_paths(spark, folder):
    ranked = R.rank_paths(_paths(spark, folder), ["field"], F.lit(NOW).cast("timestamp"))
    return ranked.select("field", "path", F.floor(F.col("score") * 1e6 + 0.5).alias("score_e6"), F.col("rank").cast("long").alias("rank"))


RANKED_PATHS = _PATHS + "SELECT field, path, CAST(floor(score * 1e6 + 0.5) AS BIGINT) AS score_e6, rank FROM r"


def pruned_paths(spark, folder):
    return R.prune_paths(_paths(spark, folder), ["field"], F.lit(NOW).cast("timestamp")).select("field", "path")


PRUNED_PATHS = _PATHS + """
, k AS (SELECT *, pinned OR source = 'human' AS guard FROM r WHERE pinned OR source = 'human' OR hits + misses < 5 OR hits / (hits + misses) > 0.1),
n AS (SELECT *, row_number() OVER (PARTITION BY field, guard ORDER BY rank) AS n, count(*) FILTER (guard) OVER (PARTITION BY field) AS g FROM k)
SELECT field, path FROM n WHERE guard OR n <= 5 - g
"""


def verified_paths(spark, folder):
    ranked = R.rank_verified(_paths(spark, folder).where("source <> 'human'"), ["field"])
    return ranked.select("field", "path", F.col("rank").cast("long").alias("rank"))


VERIFIED_PATHS = _PATHS + """
SELECT field, path, row_number() OVER (PARTITION BY field ORDER BY pinned DESC, hits / (hits + misses) DESC, CASE source WHEN 'api' THEN 0 WHEN 'json-ld' THEN 1 WHEN 'meta' THEN 2 ELSE 3 END, length(path), path) AS rank FROM p WHERE source <> 'human'
"""


def spread_paths(spark, folder):
    """At most two of a source, five in all, pinned ones first."""
    ranked = R.rank_certified(_paths(spark, folder).where("source <> 'human'"), ["field"])
    return R.spread_sources(ranked, ["field"], "source").select("field", "path", F.col("place").cast("long").alias("place"))


SPREAD_PATHS = _PATHS + """
, c AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY CASE source WHEN 'api' THEN 0 WHEN 'json-ld' THEN 1 WHEN 'meta' THEN 2 ELSE 3 END, length(path), path) AS cr FROM p WHERE source <> 'human'),
d AS (SELECT *, min(cr) OVER (PARTITION BY field, source) AS best, count(*) FILTER (pinned) OVER (PARTITION BY field, source) AS held, row_number() OVER (PARTITION BY field, source, pinned ORDER BY cr) AS turn FROM c),
e AS (SELECT *, CASE WHEN pinned THEN 0 ELSE held + turn END AS round FROM d), f AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY round, CASE WHEN pinned THEN cr ELSE best END, cr) AS n FROM e WHERE round <= 2)
SELECT field, path, n AS place FROM f WHERE n <= 5
"""


def _jobs(spark, folder):
    """Events as jobs: types and users give status, lane and times."""
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    status = F.when(F.col("event_id") % 4 == 0, "queued").when(F.col("event_id") % 4 == 1, "running").when(F.col("event_id") % 4 == 2, "done").otherwise("failed")
    minutes = lambda n: F.col("ts") + F.make_dt_interval(mins=F.lit(n))
    started = F.when(status != "queued", minutes(5))
    return events.select(
        F.col("event_id").alias("id"), F.lit("main").alias("queue"), F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("key"), status.alias("status"), F.floor("value").cast("int").alias("priority"),
        (F.col("event_id") % 3).cast("int").alias("attempts"), F.lit(2).alias("max_attempts"), F.col("ts").alias("run_after"), F.when(F.col("event_id") % 8 == 0, minutes(600)).alias("expires_at"), F.concat(F.lit("w"), F.col("user_id") % 5, F.lit("#a")).alias("locked_by"),
        F.when(status == "running", minutes(30)).alias("locked_until"), started.alias("started_at"), F.when(status == "running", minutes(6)).alias("progress_at"), F.when(status.isin("done", "failed"), minutes(20)).alias("finished_at"), F.col("ts").alias("created_at"),
    )


_JOBS = f"""
WITH j AS (SELECT event_id AS id, event_type AS type, user_id, ['queued', 'running', 'done', 'failed'][1 + event_id % 4] AS status, CAST(floor(value) AS INTEGER) AS priority, CAST(event_id % 3 AS INTEGER) AS attempts, 2 AS max_attempts, ts AS run_after,
  CASE WHEN event_id % 8 = 0 THEN ts + INTERVAL 600 MINUTE END AS expires_at, CASE WHEN event_id % 4 = 1 THEN ts + INTERVAL 30 MINUTE END AS locked_until, CASE WHEN event_id % 4 <> 0 THEN ts + INTERVAL 5 MINUTE END AS started_at,
  CASE WHEN event_id % 4 = 1 THEN ts + INTERVAL 6 MINUTE END AS progress_at, CASE WHEN event_id % 4 >= 2 THEN ts + INTERVAL 20 MINUTE END AS finished_at, TIMESTAMP '{NOW}' AS now FROM events)
"""


def _now():
    return F.lit(NOW).cast("timestamp")


def next_jobs(spark, folder):
    picked = Q.next_per_lane(_jobs(spark, folder), "type", _now())
    return picked.select("type", "id", "priority")


NEXT_JOBS = _JOBS + "SELECT DISTINCT ON (type) type, id, priority FROM j WHERE status = 'queued' AND run_after <= now AND (expires_at IS NULL OR expires_at > now) ORDER BY type, priority, run_after, id"


def enqueued(spark, folder):
    """Users without a queued or running job get one."""
    specs = table(spark, folder, "events").select(F.col("event_id").alias("id"), F.lit("main").alias("queue"), F.col("user_id").cast("string").alias("key"))
    return Q.enqueue(_jobs(spark, folder), specs).select("id", "key")


ENQUEUED = _JOBS + """
, s AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS key FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)
SELECT id, key FROM s WHERE key NOT IN (SELECT CAST(user_id AS VARCHAR) FROM j WHERE status IN ('queued', 'running'))
"""


def reaped(spark, folder):
    done = Q.reaped(_jobs(spark, folder), _now(), 60).where("outcome <> 'unchanged'")
    return done.select("id", "outcome", F.coalesce(F.unix_seconds("next_run_after"), F.lit(0)).alias("retry_at"))


REAPED = _JOBS + """
, o AS (SELECT id, attempts, now, CASE WHEN status = 'running' AND locked_until < now AND attempts < max_attempts THEN 'retried' WHEN status = 'running' AND locked_until < now THEN 'stalled' WHEN status = 'queued' AND expires_at < now THEN 'expired' END AS outcome FROM j)
SELECT id, outcome, CASE WHEN outcome = 'retried' THEN CAST(epoch(now) AS BIGINT) + CAST(60 * pow(2, greatest(attempts - 1, 0)) AS BIGINT) ELSE 0 END AS retry_at FROM o WHERE outcome IS NOT NULL
"""


def queue_overview(spark, folder):
    seen = Q.overview(_jobs(spark, folder), _now())
    ms = lambda c: F.floor(F.col(c) + 0.5).alias(c)
    return seen.select("type", "queued", "running", "done", "failed", ms("oldest_queued_ms"), ms("longest_running_ms"))


QUEUE_OVERVIEW = _JOBS + """
SELECT type, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'done' AND finished_at > now - INTERVAL 1 DAY) AS done,
  count(*) FILTER (status = 'failed' AND finished_at > now - INTERVAL 1 DAY) AS failed, CAST(floor((epoch_us(any_value(now)) - epoch_us(min(run_after) FILTER (status = 'queued' AND run_after <= now))) / 1000.0::DOUBLE + 0.5) AS BIGINT) AS oldest_queued_ms,
  CAST(floor((epoch_us(any_value(now)) - epoch_us(min(started_at) FILTER (status = 'running'))) / 1000.0::DOUBLE + 0.5) AS BIGINT) AS longest_running_ms
FROM j GROUP BY 1 HAVING count(*) FILTER (status IN ('queued', 'running') OR finished_at > now - INTERVAL 1 DAY) > 0
"""


def backlog(spark, folder):
    """Waiting jobs of lanes in which nothing happened of late: of three lanes one is idle."""
    jobs = _jobs(spark, folder).where("type <> 'error' OR status = 'queued'")
    lanes = spark.createDataFrame([("view", "a"), ("click", "a"), ("error", "b"), ("purchase", "c")], "type string, lane string")
    return Q.backlog(jobs, lanes, _now()).select("id", "type")


BACKLOG = _JOBS + """
, k AS (SELECT * FROM j LEFT JOIN (VALUES ('view', 'a'), ('click', 'a'), ('error', 'b'), ('purchase', 'c')) l(t, lane) ON t = type WHERE type <> 'error' OR status = 'queued'),
busy AS (SELECT DISTINCT lane FROM k WHERE status = 'running' OR started_at > now - INTERVAL 10 MINUTE OR finished_at > now - INTERVAL 10 MINUTE)
SELECT id, type FROM k WHERE status = 'queued' AND run_after < now - INTERVAL 10 MINUTE AND (lane IS NULL OR lane NOT IN (SELECT lane FROM busy WHERE lane IS NOT NULL))
"""


def silent_jobs(spark, folder):
    return Q.silent(_jobs(spark, folder), F.lit(600), _now()).select("id", F.floor(F.col("age_seconds") + 0.5).alias("age"))


SILENT_JOBS = _JOBS + "SELECT id, CAST(floor(epoch_us(now) / 1e6 - epoch_us(progress_at) / 1e6 + 0.5) AS BIGINT) AS age FROM j WHERE status = 'running' AND locked_until > now AND epoch_us(now) / 1e6 - epoch_us(progress_at) / 1e6 > 300"


def dead_workers(spark, folder):
    """Running jobs of workers that went silent two minutes ago."""
    workers = spark.createDataFrame([("w0", 1), ("w1", 0), ("w2", 10), ("w3", 0)], "id string, m int").select("id", (F.lit(NOW).cast("timestamp") - F.make_dt_interval(mins=F.col("m"))).alias("beat_at"))
    return Q.dead_worker_jobs(_jobs(spark, folder), workers, _now()).select("id", "worker_id")


DEAD_WORKERS = _JOBS + "SELECT id, 'w2' AS worker_id FROM j WHERE status = 'running' AND user_id % 5 = 2"


def due_sweep(spark, folder):
    sources = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), (F.lit(NOW).cast("timestamp") + F.make_dt_interval(mins=(F.col("c_acctbal") * -1).cast("int"))).alias("next_run_at"), (F.col("c_custkey") % 5 != 0).alias("is_active"), (F.col("c_custkey") % 3 != 0).alias("certified"),
        F.lit("listing_to_detail").alias("listing_mode"), F.when(F.col("c_custkey") % 2 == 0, F.lit(NOW)).cast("timestamp").alias("confirmed_at"), (F.col("c_custkey") % 4 == 0).alias("running"),
    )
    return Q.due_sweep(sources, _now()).select("id", F.coalesce("skip_reason", F.lit("")).alias("skip_reason"))


DUE_SWEEP = """
SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'paused' WHEN c_custkey % 3 = 0 THEN 'not_certified' WHEN c_custkey % 2 <> 0 THEN 'not_confirmed' WHEN c_custkey % 4 = 0 THEN 'busy' ELSE '' END AS skip_reason
FROM customer WHERE CAST(trunc(-c_acctbal) AS INTEGER) <= 0 ORDER BY CAST(trunc(-c_acctbal) AS INTEGER), c_custkey LIMIT 6
"""


def rate_limited(spark, folder):
    """Two calls of a user a day; windows start at their first call."""
    events = table(spark, folder, "events").select("event_id", "user_id", "ts")
    return Q.rate_limited(events, "user_id", "ts", ["ts", "event_id"], 2, 86_400.0).select("event_id", "user_id", "taken")


RATE_LIMITED = """
WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT event_id, user_id, n, t AS start, 1 AS c, true AS taken FROM o WHERE n = 1
  UNION ALL SELECT o.event_id, o.user_id, o.n, CASE WHEN o.t - start >= 86400 THEN o.t ELSE start END, CASE WHEN o.t - start >= 86400 THEN 1 ELSE least(c + 1, 2) END, o.t - start >= 86400 OR c < 2 FROM w JOIN o ON o.user_id = w.user_id AND o.n = w.n + 1)
SELECT event_id, user_id, taken FROM w
"""


def host_backoff(spark, folder):
    verdict = F.when(F.col("event_type") == "error", "challenge").when(F.col("event_type") == "view", "ok").otherwise("timeout")
    events = table(spark, folder, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), verdict.alias("verdict"))
    paused = Q.host_backoff(events, "user_id", "ts", ["ts", "event_id"])
    return paused.select("event_id", F.col("strikes").cast("long").alias("strikes"), F.coalesce(F.floor((F.unix_micros("until") - F.unix_micros("ts")) / 1e6 + 0.5), F.lit(0)).alias("pause"))


HOST_BACKOFF = """
WITH s AS (SELECT *, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spell FROM events),
k AS (SELECT *, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, spell ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS strikes FROM s)
SELECT event_id, strikes, CASE WHEN event_type = 'error' THEN CAST(least(480, 120 * pow(2, strikes - 1)) AS BIGINT) ELSE 0 END AS pause FROM k
"""


def certified_values(spark, folder):
    """Readings of ranked paths: lines of an order as paths of its fields, empty below a quantity."""
    lines = table(spark, folder, "lineitem")
    once = lines.groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("path_rank")).agg(F.max("l_quantity").alias("q"))
    readings = once.select("page", F.lit("quantity").alias("field"), "path_rank", F.concat(F.lit("p"), "path_rank").alias("path"), F.lit("api").alias("source"), F.when(F.col("q") >= 20, F.col("q").cast("int").cast("string")).alias("value"))
    found = E.certified(readings, ["page"])
    return found.select("page", F.coalesce("value", F.lit("")).alias("value"), F.col("tried").cast("long").alias("tried"), "hit")


CERTIFIED_VALUES = """
WITH r AS (SELECT l_orderkey AS page, l_linenumber AS n, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
SELECT page, coalesce(CAST(CAST(arg_min(q, n) FILTER (q >= 20) AS INTEGER) AS VARCHAR), '') AS value, coalesce(min(n) FILTER (q >= 20), count(*)) AS tried, count(*) FILTER (q >= 20) > 0 AS hit FROM r GROUP BY 1
"""


def path_outcomes(spark, folder):
    lines = table(spark, folder, "lineitem")
    once = lines.groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("path_rank")).agg(F.max("l_quantity").alias("q"))
    readings = once.select("page", F.lit("quantity").alias("field"), "path_rank", F.concat(F.lit("p"), "path_rank").alias("path"), F.lit("api").alias("source"), F.when(F.col("q") >= 20, F.col("q").cast("string")).alias("value"))
    return E.path_outcomes(readings, ["page"]).select("path", "hits", "misses")


PATH_OUTCOMES = """
WITH r AS (SELECT l_orderkey AS page, l_linenumber AS n, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), f AS (SELECT *, min(n) FILTER (q >= 20) OVER (PARTITION BY page) AS first FROM r)
SELECT 'p' || n AS path, count(*) FILTER (n = first) AS hits, count(*) FILTER (first IS NULL OR n < first) AS misses FROM f WHERE first IS NULL OR n <= first GROUP BY 1
"""


def merged_observations(spark, folder):
    """Confidence of stored paths after a user's events as observations, clamped at every step."""
    events = table(spark, folder, "events")
    observed = events.select(F.col("user_id").alias("field"), F.lit("api").alias("source"), F.col("event_type").alias("path"), F.col("event_id").alias("seq"), (F.col("value") > 15).alias("hit"), F.col("value").cast("string").alias("value"), F.col("ts").cast("timestamp").alias("at"), F.lit(0.8).alias("confidence"))
    stored = events.where("event_type IN ('view', 'click')").select(F.col("user_id").alias("field"), F.lit("api").alias("source"), F.col("event_type").alias("path")).distinct()
    stored = stored.withColumns({"confidence": F.lit(0.5), "hits": F.lit(3), "misses": F.lit(1), "last_value": F.lit("old"), "last_used_at": F.lit(None).cast("timestamp"), "pinned": F.lit(False)})
    merged = E.merge_observations(stored, observed, ["field"])
    return merged.select("field", "path", F.col("hits").cast("long").alias("hits"), F.col("misses").cast("long").alias("misses"), F.floor(F.col("confidence") * 1e6 + 0.5).alias("confidence_e6"))


MERGED_OBSERVATIONS = """
WITH RECURSIVE o AS (SELECT user_id AS field, event_type AS path, value > 15 AS hit, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events),
c AS (SELECT field, path, n, CASE WHEN path NOT IN ('view', 'click') THEN 0.8::DOUBLE WHEN hit THEN least(1.0::DOUBLE, 0.5::DOUBLE + 0.02::DOUBLE) ELSE greatest(0.0::DOUBLE, 0.5::DOUBLE - 0.05::DOUBLE) END AS c FROM o WHERE n = 1
  UNION ALL SELECT o.field, o.path, o.n, CASE WHEN hit THEN least(1.0::DOUBLE, c + 0.02::DOUBLE) ELSE greatest(0.0::DOUBLE, c - 0.05::DOUBLE) END FROM c JOIN o ON o.field = c.field AND o.path = c.path AND o.n = c.n + 1),
t AS (SELECT field, path, count(*) FILTER (hit) AS h, count(*) FILTER (NOT hit) AS m, max(n) AS n FROM o GROUP BY 1, 2)
SELECT field, path, h + CASE WHEN path IN ('view', 'click') THEN 3 ELSE 0 END AS hits, m + CASE WHEN path IN ('view', 'click') THEN 1 ELSE 0 END AS misses, CAST(floor(c * 1e6 + 0.5) AS BIGINT) AS confidence_e6 FROM t JOIN c USING (field, path, n)
"""


def cache_lookup(spark, folder):
    """Stored rows by domain, else by brand: names of suppliers made into hosts."""
    cache = table(spark, folder, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("shop.b"), F.col("s_suppkey") % 10, F.lit(".com")).alias("domain"), F.lit("detail").alias("page_type"), "s_suppkey")
    cache = cache.groupBy("domain", "page_type").agg(F.max("s_suppkey").alias("successful_runs"))
    wanted = spark.range(12).select(F.concat(F.when(F.col("id") % 2 == 0, "shop.b").otherwise("www.b"), F.col("id"), F.lit(".com")).alias("domain"), F.lit("detail").alias("page_type"))
    return E.lookup_cache(wanted, cache).select("domain", F.coalesce("found.domain", F.lit("")).alias("found"), "is_exact")


CACHE_LOOKUP = """
WITH c AS (SELECT DISTINCT 'shop.b' || s_suppkey % 10 || '.com' AS domain FROM supplier WHERE s_suppkey % 3 = 0), w AS (SELECT CASE WHEN id % 2 = 0 THEN 'shop.b' ELSE 'www.b' END || id || '.com' AS domain, 'shop.b' || id || '.com' AS kin FROM range(12) r(id))
SELECT w.domain, coalesce(c.domain, '') AS found, coalesce(w.domain = c.domain, false) AS is_exact FROM w LEFT JOIN c ON c.domain = w.kin
"""


def json_paths(spark, folder):
    """Values of events' properties by a path column, in buckets of ten, and stable text."""
    events = table(spark, folder, "events").select("event_type", "props")
    value = by_path(F.col("props"), F.when(F.col("event_type") == "error", F.lit("none")).otherwise(F.lit("k"))).try_cast("int")
    rows = events.select(F.floor(value / 10).alias("b"), F.length(stable_json(F.col("props"))).alias("l"))
    return rows.groupBy(F.coalesce("b", F.lit(-1)).alias("bucket")).agg(F.count("*").alias("events"), F.sum("l").alias("chars"))


JSON_PATHS = """
SELECT CASE WHEN event_type = 'error' THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) // 10 END AS bucket, count(*) AS events, CAST(sum(length(replace(props, ' ', ''))) AS BIGINT) AS chars FROM events GROUP BY 1
"""


def lean_readings(orders):
    """Orders as items of their customers' runs, two fields each: one that the quick reading misses or reads otherwise, one
    that it does not show."""
    k = F.col("o_orderkey")
    false_if = lambda test: F.when(test, False).otherwise(True)
    first = F.struct(F.lit("a").alias("field"), F.when(k % 4 != 0, F.when(k % 31 == 0, F.lit("other")).otherwise(F.lit("v"))).alias("lean"), F.when(k % 12 != 0, F.lit("v")).alias("full"), F.lit(True).alias("lean_shown"), F.lit(True).alias("full_shown"), F.lit(True).alias("has_paths"))
    second = F.struct(F.lit("b").alias("field"), F.lit("w").alias("lean"), F.lit("w").alias("full"), false_if(k % 5 == 0).alias("lean_shown"), false_if((k % 5 == 0) & (k % 3 != 0)).alias("full_shown"), F.lit(True).alias("has_paths"))
    return orders.select(F.col("o_custkey").alias("run"), F.col("o_orderdate").alias("o_orderdate"), "o_orderkey", F.explode(F.array(first, second)).alias("r")).select("run", "o_orderdate", "o_orderkey", "r.*")


def lean_outcomes(spark, folder):
    """How each item of a run is read, by the rule's own thresholds."""
    found = LEAN.lean_outcomes(lean_readings(table(spark, folder, "orders")), "run", ["o_orderdate", "o_orderkey"])
    text = lambda c: F.array_join(c, ",").alias(c)
    return found.select("run", "o_orderkey", "mode", F.coalesce("reason", F.lit("")).alias("reason"), text("fields"), text("disagreed"), text("rescued"))


LEAN_OUTCOMES = """
WITH RECURSIVE o AS (SELECT o_custkey AS run, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
t(run, k, n, reason, fields, dis, res, checks, streak, ma, ub, whole) AS (
  SELECT run, CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', '', '', '', 2, 0, 0, 0, false FROM (SELECT DISTINCT run FROM o)
  UNION ALL
  SELECT run, k, n, reason, CASE reason WHEN 'miss' THEN 'a' WHEN 'unshown' THEN 'b' ELSE '' END, CASE WHEN both_ways AND k % 4 <> 0 AND k % 31 = 0 THEN 'a' ELSE '' END,
    concat_ws(',', CASE WHEN ra THEN 'a' END, CASE WHEN rb THEN 'b' END), checks - CAST(reason = 'check' AS INTEGER), CASE WHEN reason = 'switched' THEN streak WHEN ra OR rb THEN streak + 1 ELSE 0 END,
    CASE WHEN ra THEN 0 WHEN both_ways AND k % 12 = 0 THEN ma + 1 ELSE ma END, CASE WHEN rb THEN 0 WHEN both_ways AND k % 5 = 0 THEN ub + 1 ELSE ub END,
    whole OR (both_ways AND k % 4 <> 0 AND k % 31 = 0) OR ((ra OR rb) AND streak + 1 >= 3)
  FROM (SELECT *, both_ways AND k % 4 = 0 AND k % 12 <> 0 AS ra, both_ways AND k % 15 = 0 AS rb FROM (SELECT *, reason IN ('check', 'miss', 'unshown') AS both_ways FROM (
    SELECT t.run, o.k, o.n, checks, streak, ma, ub, whole, CASE WHEN whole THEN 'switched' WHEN checks > 0 THEN 'check' WHEN o.k % 4 = 0 AND ma < 3 THEN 'miss' WHEN o.k % 5 = 0 AND ub < 3 THEN 'unshown' ELSE '' END AS reason
    FROM t JOIN o ON t.run = o.run AND o.n = t.n + 1))))
SELECT run, k AS o_orderkey, CASE reason WHEN '' THEN 'lean' WHEN 'switched' THEN 'full' ELSE 'lean+full' END AS mode, reason, fields, dis AS disagreed, res AS rescued FROM t WHERE n > 0
"""


def certify_layout(spark, folder):
    """Paths (lines' suppliers modulo ten) against orders' expected values: those right on every page."""
    lines = table(spark, folder, "lineitem")
    readings = lines.select(F.lit("f").alias("field"), F.col("l_orderkey").alias("url"), F.lit("api").alias("source"), F.concat(F.lit("p"), F.col("l_linenumber")).alias("path"), "l_linenumber").distinct()
    readings = readings.select("field", "url", "source", "path", F.when((F.col("url") + F.col("l_linenumber")) % 3 != 0, F.lit("v")).alias("raw"))
    pages = readings.select("field", "url").distinct().withColumns({"expected": F.lit("v"), "absent": F.lit(False), "default_cell": F.lit(False)})
    checked = K.safe_paths(K.evaluate(readings, pages, F.col("raw") == F.col("expected")))
    return checked.select("path", "safe", "everywhere", "proven_pages", "wrong_pages")


CERTIFY_LAYOUT = """
WITH r AS (SELECT DISTINCT l_orderkey AS url, l_linenumber AS n FROM lineitem), e AS (SELECT *, (url + n) % 3 <> 0 AS ok FROM r)
SELECT 'p' || n AS path, true AS safe, bool_and(ok) AS everywhere, count(*) FILTER (ok) AS proven_pages, CAST(0 AS BIGINT) AS wrong_pages FROM e GROUP BY n
"""


def attention(spark, folder):
    """Fields whose newest check failed after the last clean verification."""
    checks = table(spark, folder, "events").select(F.col("user_id").alias("source"), F.col("event_type").alias("field"), F.when(F.col("value") > 10, "bad").otherwise("ok").alias("outcome"), F.col("ts").alias("checked_at"), F.lit("2024-01-25").cast("timestamp_ntz").alias("verified_at"))
    return reports.attention(checks, "source").select("source", "field")


ATTENTION = """
WITH d AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events), l AS (SELECT DISTINCT ON (user_id, event_type) user_id, event_type, value, ts FROM d WHERE n <= 5 ORDER BY user_id, event_type, ts DESC)
SELECT user_id AS source, event_type AS field FROM l WHERE value > 10 AND ts > TIMESTAMP '2024-01-25'
"""


def overview_rows(spark, folder):
    rows = table(spark, folder, "supplier").select(F.col("s_name").alias("name"), (F.col("s_suppkey") % 9 == 0).alias("drifted"), F.when(F.col("s_suppkey") % 5 == 0, "failed").otherwise("completed").alias("last_status"), (F.col("s_suppkey") % 2 == 0).alias("verified"))
    return reports.overview_order(rows).select("name", F.col("rank").cast("long").alias("rank"))


OVERVIEW_ROWS = "SELECT s_name AS name, CAST(CASE WHEN s_suppkey % 9 = 0 THEN 0 WHEN s_suppkey % 5 = 0 THEN 1 WHEN s_suppkey % 2 <> 0 THEN 2 ELSE 3 END AS BIGINT) AS rank FROM supplier ORDER BY rank, name"


QUERIES = {
    "ranked_paths": (ranked_paths, RANKED_PATHS),
    "pruned_paths": (pruned_paths, PRUNED_PATHS),
    "verified_paths": (verified_paths, VERIFIED_PATHS),
    "spread_paths": (spread_paths, SPREAD_PATHS),
    "next_jobs": (next_jobs, NEXT_JOBS),
    "enqueued": (enqueued, ENQUEUED),
    "reaped": (reaped, REAPED),
    "queue_overview": (queue_overview, QUEUE_OVERVIEW),
    "backlog": (backlog, BACKLOG),
    "silent_jobs": (silent_jobs, SILENT_JOBS),
    "dead_workers": (dead_workers, DEAD_WORKERS),
    "due_sweep": (due_sweep, DUE_SWEEP),
    "rate_limited": (rate_limited, RATE_LIMITED),
    "host_backoff": (host_backoff, HOST_BACKOFF),
    "certified_values": (certified_values, CERTIFIED_VALUES),
    "path_outcomes": (path_outcomes, PATH_OUTCOMES),
    "merged_observations": (merged_observations, MERGED_OBSERVATIONS),
    "cache_lookup": (cache_lookup, CACHE_LOOKUP),
    "json_paths": (json_paths, JSON_PATHS),
    "certify_layout": (certify_layout, CERTIFY_LAYOUT),
    "lean_outcomes": (lean_outcomes, LEAN_OUTCOMES),
    "attention": (attention, ATTENTION),
    "overview_rows": (overview_rows, OVERVIEW_ROWS),
}
