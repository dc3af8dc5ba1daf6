"""Secrets in lines of text: what is masked, and what is left alone."""

import pytest
from pyspark.sql import functions as F

from skein.functions.redaction import redact_text
from skein.plans.catalogue import queries

LINES = [
    ("authorization: bearer abc12", "authorization: bearer ***"),
    ("Proxy-Authorization:  Basic dXNlcjpwdw== tail", "Proxy-Authorization:  Basic ***"),
    ("Authorization: Digest a=b, c=d\r\nok", "Authorization: ***\r\nok"),
    ("http://u:pa/ss@h:1", "http://***@h:1"),
    ("http://u@p@host/x", "http://***@host/x"),
    ("joe:hunter2@db.example:5432", "***@db.example:5432"),
    ("at host:8080/path?e=a@b.c", "at host:8080/path?e=a@b.c"),
    ("?key=abc123&monkey=1", "?key=***&monkey=1"),
    ("Cookie: sid=abc; other=def", "Cookie: ***"),
    ("Set-Cookie: a=b\nnext: line", "Set-Cookie: ***\nnext: line"),
    ("next=postgres%3A%2F%2Fu:p%40h%2Fdb", "next=postgres%3A%2F%2F***%40h%2Fdb"),
    ("params: 1,secret\nrest", "params: ***\nrest"),
    ('{"token":"abc","design":"x"}', '{"token":"***","design":"x"}'),
    ("mail joe@example.com, 10:30 to 11:00", "mail joe@example.com, 10:30 to 11:00"),
    ("a basic idea, the bearer of", "a basic idea, the bearer ***"),
    ("", ""),
    (None, None),
]


@pytest.fixture(scope="module")
def redacted(spark):
    rows = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(LINES)], "n int, t string")
    return {r.n: r.out for r in rows.select("n", redact_text(F.col("t")).alias("out")).collect()}


@pytest.mark.parametrize("n", range(len(LINES)))
def test_lines(redacted, n):
    assert redacted[n] == LINES[n][1]


def test_a_small_file_of_customers_is_read_by_many_tasks(spark, sf_dir):
    found = queries()["redacted"](spark, sf_dir)
    parts = {r.part for r in found.select("c_custkey", F.spark_partition_id().alias("part")).collect()}
    assert len(parts) >= spark.sparkContext.defaultParallelism


def test_a_value_is_worked_out_once(spark):
    """The rules stand once in the plan, however often their result is read."""
    plan = spark.range(1).select(redact_text(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("params:") <= 2
