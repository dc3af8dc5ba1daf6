"""Tasks of queries over wide expansions: their number grows with the rows, whatever the session's own number."""

import pytest
from pyspark.sql import functions as F

from skein.plans import catalogue
from skein.sources import tables


@pytest.mark.parametrize("name", ["variant_list_ranks", "spread_paths", "flattened_responses"])
def test_parts_grow_with_the_rows(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(tables, "TASK_ROWS", 100)
    found = catalogue.queries()[name](spark, sf_dir)
    parts = found.select(F.spark_partition_id().alias("part")).distinct().count()
    assert parts > 4 * spark.sparkContext.defaultParallelism


def test_proof_pages_are_read_by_all_tasks(spark, sf_dir, monkeypatch):
    """Pages made of small tables come in one part, but each of them costs a reader much."""
    from skein.plans import proofs

    parts, nodes = [], proofs.H.nodes

    def noted(pages, *columns):
        parts.append(pages.rdd.getNumPartitions())
        return nodes(pages, *columns)

    monkeypatch.setattr(tables, "TASK_ROWS", 20)
    monkeypatch.setattr(proofs.H, "nodes", noted)
    catalogue.queries()["link_messages"](spark, sf_dir)
    assert parts[0] >= spark.sparkContext.defaultParallelism


def test_planned_inputs_are_read_together_once(spark, sf_dir, monkeypatch):
    """Each reading together moves all rows again; runs folded in order need one, and plan the same."""
    from skein.operators import crawl

    looks, look = [], crawl._look
    monkeypatch.setattr(crawl, "_look", lambda *given: looks.append(1) or look(*given))
    catalogue.queries()["planned_reports"](spark, sf_dir)
    assert len(looks) == 1
    rows = spark.range(400).selectExpr("id % 3 AS run", "id % 4 AS input", "id % 5 AS page", "id AS pos", "concat('u', pmod(xxhash64(id), 40)) AS url")
    folded, read = (crawl.walk(rows, 6, looks=n)[0].select("run", "input", "url", "page", "place").collect() for n in (0, 4))
    assert sorted(folded) == sorted(read)


@pytest.mark.parametrize("name", ["planned_addresses", "planned_reports"])
def test_plans_broadcast_nothing(spark, sf_dir, name):
    """Parts and held addresses are small files of many long rows, which the driver would hold whole."""
    plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_runs_and_their_held_addresses_meet_without_broadcasts(spark, monkeypatch):
    from skein.operators import crawl

    plans, look = [], crawl._look

    def noted(*given):
        found = look(*given)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    monkeypatch.setattr(crawl, "_look", noted)
    rows = spark.range(400).selectExpr("id % 3 AS run", "id % 4 AS input", "id % 5 AS page", "id AS pos", "concat('u', pmod(xxhash64(id), 40)) AS url")
    assert crawl.walk(rows, 6, looks=2)[0].count() and len(plans) == 3 and not any("Broadcast" in p for p in plans)
