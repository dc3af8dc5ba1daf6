"""Work-queue operators over a jobs table, as set-based selections and updates.

A jobs row: id, queue, type, key, status, priority, attempts, max_attempts, run_after, expires_at, locked_by,
locked_until, started_at, progress_at, finished_at, created_at. ``now`` is a column (a literal, or a table's clock).
Updates return the changed table; nothing is locked, as one batch job writes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .relational import small


def due(now: Column) -> Column:
    return (F.col("status") == "queued") & (F.col("run_after") <= now) & (F.col("expires_at").isNull() | (F.col("expires_at") > now))


def next_per_lane(jobs: DataFrame, lane: str, now: Column) -> DataFrame:
    """The job each lane would claim: lowest priority number, earliest due, oldest; ids break ties."""
    order = F.struct("priority", "run_after", "created_at", "id")
    first = F.min_by(F.struct(*jobs.columns), order)
    return jobs.where(due(now)).groupBy(F.col(lane).alias("_lane")).agg(first.alias("j")).select("j.*")


def claimed(jobs: DataFrame, picked: DataFrame, worker: str, lease_seconds: int, now: Column) -> DataFrame:
    """The jobs table after ``picked`` (ids) are claimed."""
    marked = jobs.join(picked.select("id").withColumn("_picked", F.lit(True)), "id", "left")
    take = F.coalesce("_picked", F.lit(False))
    lease = now + F.make_dt_interval(secs=F.lit(lease_seconds))
    changes = {"status": F.lit("running"), "attempts": F.col("attempts") + 1, "locked_by": F.concat(F.lit(f"{worker}#"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 8))}
    changes |= {"locked_until": lease, "started_at": now, "progress_at": now}
    return marked.withColumns({c: F.when(take, v).otherwise(F.col(c)) for c, v in changes.items()}).drop("_picked")


def enqueue(jobs: DataFrame, specs: DataFrame) -> DataFrame:
    """``specs`` whose key has no queued or running job; of several with one key the first id. Null keys never clash."""
    active = jobs.where(F.col("status").isin("queued", "running")).select("queue", "key")
    once = F.when(F.col("key").isNull(), F.lit(1)).otherwise(F.row_number().over(W.partitionBy("queue", "key").orderBy("id")))
    return specs.withColumn("_n", once).where("_n = 1").drop("_n").join(active, ["queue", "key"], "left_anti")


def reaped(jobs: DataFrame, now: Column, retry_base_seconds: int) -> DataFrame:
    """Adds outcome and next_run_after: a lapsed lease is retried after base * 2^(attempts - 1) seconds while attempts
    are left, else failed as stalled; a queued job past its window is failed as expired; others are unchanged."""
    lapsed = F.coalesce((F.col("status") == "running") & (F.col("locked_until") < now), F.lit(False))
    late = F.coalesce((F.col("status") == "queued") & (F.col("expires_at") < now), F.lit(False))
    left = F.col("attempts") < F.col("max_attempts")
    delay = retry_base_seconds * F.pow(F.lit(2.0), F.greatest(F.col("attempts") - 1, F.lit(0)))
    outcome = F.when(lapsed & left, "retried").when(lapsed, "stalled").when(late, "expired").otherwise("unchanged")
    return jobs.withColumn("outcome", outcome).withColumn("next_run_after", F.when(lapsed & left, now + F.make_dt_interval(secs=delay)))


def stale_runs(runs: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Items running for longer than ``minutes`` go back to pending."""
    stale = (F.col("status") == "running") & (F.col("started_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return runs.withColumn("requeued", F.coalesce(stale, F.lit(False))).withColumn("status", F.when(F.col("requeued"), "pending").otherwise(F.col("status")))


def overview(jobs: DataFrame, now: Column) -> DataFrame:
    """Per type: queued, running, done and failed within a day, ages of the oldest queued and longest running in
    milliseconds; types with nothing going on are left out."""
    day_ago = now - F.expr("INTERVAL 1 DAY")
    status = lambda s: F.col("status") == s
    recent = F.col("finished_at") > day_ago
    age = lambda t: (F.unix_micros(now) - F.unix_micros(t)) / 1000.0
    grouped = jobs.groupBy("type").agg(
        F.count_if(status("queued")).alias("queued"),
        F.count_if(status("running")).alias("running"),
        F.count_if(status("done") & recent).alias("done"),
        F.count_if(status("failed") & recent).alias("failed"),
        age(F.min(F.when(status("queued") & (F.col("run_after") <= now), F.col("run_after")))).alias("oldest_queued_ms"),
        age(F.min(F.when(status("running"), F.col("started_at")))).alias("longest_running_ms"),
        F.count_if(F.col("status").isin("queued", "running") | recent).alias("_live"),
    )
    return grouped.where("_live > 0").drop("_live")


def backlog(jobs: DataFrame, lanes: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """Queued jobs due for ``minutes`` whose lane (table lanes: type, lane) did nothing in that time. Jobs of types
    without a lane count too; the anti join has no null trap."""
    since = now - F.make_dt_interval(mins=F.lit(minutes))
    with_lane = jobs.join(small(lanes), "type", "left")
    busy = with_lane.where((F.col("status") == "running") | (F.col("started_at") > since) | (F.col("finished_at") > since)).select("lane").distinct()
    waiting = with_lane.where((F.col("status") == "queued") & (F.col("run_after") < since))
    return waiting.join(busy, "lane", "left_anti")


def silent(jobs: DataFrame, stuck_seconds: Column, now: Column, least: int = 45) -> DataFrame:
    """Running jobs under a live lease without progress for half their stuck time (``least`` seconds at the least)."""
    age = F.unix_micros(now) / 1e6 - F.unix_micros(F.coalesce("progress_at", "started_at")) / 1e6
    live = (F.col("status") == "running") & (F.col("locked_until") > now)
    return jobs.where(live).withColumn("age_seconds", age).where(F.col("age_seconds") > F.greatest(stuck_seconds / 2, F.lit(least)))


def dead_worker_jobs(jobs: DataFrame, workers: DataFrame, now: Column, minutes: int = 2) -> DataFrame:
    """Running jobs whose worker (the lock's name before #) has not reported for ``minutes``."""
    gone = workers.where(F.col("beat_at") < now - F.make_dt_interval(mins=F.lit(minutes))).select(F.col("id").alias("worker_id"), "beat_at")
    return jobs.where("status = 'running'").withColumn("worker_id", F.split_part("locked_by", F.lit("#"), F.lit(1))).join(small(gone), "worker_id")


def closed_rows(rows: DataFrame, dead: DataFrame, job_col: str = "job_id") -> DataFrame:
    """Rows of dead jobs (id, error) that were still going are failed with the job's error."""
    marked = rows.join(dead.select(F.col("id").alias(job_col), F.col("error").alias("_error"), F.lit(True).alias("_dead")), job_col, "left")
    close = F.coalesce("_dead", F.lit(False)) & F.col("status").isin("pending", "running", "planning", "extracting")
    return marked.withColumns({"status": F.when(close, "failed").otherwise(F.col("status")), "error": F.when(close, F.col("_error")).otherwise(F.col("error"))}).drop("_error", "_dead")


def due_sweep(sources: DataFrame, now: Column, most: int = 6) -> DataFrame:
    """The earliest ``most`` due schedules and why each is skipped, null if it runs: paused, not_certified,
    not_confirmed, busy, in this order."""
    ready = sources.where(F.col("next_run_at") <= now).orderBy("next_run_at", "id").limit(most)
    reason = (
        F.when(~F.col("is_active"), "paused")
        .when(~F.col("certified"), "not_certified")
        .when((F.col("listing_mode") == "listing_to_detail") & F.col("confirmed_at").isNull(), "not_confirmed")
        .when(F.col("running"), "busy")
    )
    return ready.withColumn("skip_reason", reason)


def rate_limited(calls: DataFrame, key: str, at: str, order: Sequence[str], limit: int, seconds: float = 60.0) -> DataFrame:
    """Adds ``taken``: per key, windows start at their first call and last ``seconds``; within one, ``limit`` calls are
    taken and later ones refused, which count nowhere.

    Whether a window starts depends on the one before, so a key's calls are folded in order by one task. They arrive
    sorted, in batches, and the fold keeps one window: memory does not grow with a key.
    """
    stamped = calls.withColumn("_at", F.unix_micros(F.col(at).cast("timestamp")) / 1e6)
    schema = stamped.schema.add("taken", "boolean")
    sorted_calls = stamped.repartition(F.col(key)).sortWithinPartitions(key, *order)

    def folds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start: dict = {}
        for rows in batches:
            taken = []
            for k, t in zip(rows[key], rows["_at"]):
                first, count = start.get(k, (None, 0))
                if first is None or t - first >= seconds:
                    start.clear()  # keys come one after another: only the current one is kept
                    first, count = t, 0
                taken.append(count < limit)
                start[k] = (first, count + (count < limit))
            yield rows.assign(taken=taken)

    return sorted_calls.mapInPandas(folds, schema).drop("_at")


def host_backoff(verdicts: DataFrame, host: str, at: str, order: Sequence[str], first: int = 120, most: int = 480) -> DataFrame:
    """Adds strikes and until: each challenge or refusal doubles a host's pause from ``first`` up to ``most`` seconds,
    an ok page (or one of another variant) clears it, other verdicts change nothing. Strikes are the walls since the
    last clearing, so two windows say it all."""
    upto = W.partitionBy(host).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    clears = F.col("verdict").isin("ok", "wrong-variant")
    wall = F.col("verdict").isin("challenge", "refused")
    islands = verdicts.withColumn("_spell", F.sum(clears.cast("int")).over(upto))
    within = W.partitionBy(host, "_spell").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    counted = islands.withColumn("strikes", F.sum(wall.cast("int")).over(within))
    pause = F.least(F.lit(float(most)), first * F.pow(F.lit(2.0), F.col("strikes") - 1))
    until = F.when(wall, F.col(at) + F.make_dt_interval(secs=pause))
    return counted.withColumn("until", until).drop("_spell")


def retry_at(failed_at: Column, attempt: Column, ladder_minutes: Sequence[int]) -> Column:
    """The next try of a ladder of waits; null when it is used up."""
    wait = F.try_element_at(F.array(*[F.lit(m) for m in ladder_minutes]), attempt.cast("int"))
    return failed_at + F.make_dt_interval(mins=wait)
