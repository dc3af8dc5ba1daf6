"""Queries against their twins on rows that larger or odder tables hold."""

import duckdb

from skein.functions import html
from skein.operators import extract
from skein.plans import catalogue
from tests.compare import rows


def _agrees(spark, folder, name, tables):
    for table, frame in tables.items():
        frame.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    with duckdb.connect() as con:
        for table in tables:
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
        want = con.execute(catalogue.oracle_sql()[name]).fetchdf()
    got = catalogue.queries()[name](spark, str(folder)).toPandas()
    assert len(want) and rows(got) == rows(want)


def test_same_pages_with_keys_of_seven_digits(spark, tmp_path):
    _agrees(spark, tmp_path, "same_pages", {"part": spark.range(999_990, 1_000_020).withColumnRenamed("id", "p_partkey")})


def test_page_fields_with_other_and_cut_entities(spark, tmp_path):
    page = '<html lang="en"><body><nav><ul><li><a href="/a&quot;b">A &lt; B</a></li></ul></nav><article><h1>One &amp; &quot;two&quot; &copy; three&amp</h1></article><footer>&copy; x &middot; y &#169;</footer></body></html>'
    _agrees(spark, tmp_path, "page_fields", {"pages": spark.createDataFrame([(1, "http://a.example/", page)], "page_id long, url string, html string")})


def test_shown_values_of_a_zero_balance(spark, tmp_path):
    rows_ = [(n, f"Customer#{n:09d}", balance, "FURNITURE") for n, balance in enumerate([0.0, 0.0, -0.0, 12.5, 0.0, 1234.0, 0.0, 0.0, 0.5])]
    _agrees(spark, tmp_path, "shown_values", {"customer": spark.createDataFrame(rows_, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string")})


def test_alias_tables_have_a_known_size(spark):
    names = extract.alias_table(spark, ["title", "price"])
    assert names.count() == 17 and int(str(names._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1_000_000


def test_node_reader_hands_on_large_pages_in_parts(spark, monkeypatch):
    page = "<html><body>a" + "".join(f"<div id='{n}'>x<br>&amp;<b>y</b>z" + ("</div>" if n % 3 else "") for n in range(40)) + "</body><i>end"
    whole = sorted(html._nodes_of(page), key=lambda e: e["pos"])
    reader = html._nodes_of(page)
    monkeypatch.setattr(html, "PIECE", 7)
    first = next(reader)
    # a void element leaves before the page is read to its end
    assert first["tag"] == "br" and first["pos"] == 3
    text = lambda rows_: [(e["pos"], e["parent"], e["xpath"], "".join(e["text"])) for e in rows_]
    assert text(whole) == text(sorted([first, *reader], key=lambda e: e["pos"]))
    frame = spark.createDataFrame([(1, page), (2, None), (3, "<p>q")], "id int, html string")
    assert {r.id: r.n for r in html.nodes(frame, "id", "html").groupBy("id").count().toDF("id", "n").collect()} == {1: len(whole), 3: 1}


def _orders(spark, per_customer):
    """Customers with so many orders each; a customer's last one has another status than the ones before."""
    made = [(c * 1000 + k + 1, c, "O" if k + 1 == n else "F", f"{k % 5}-P") for c, n in enumerate(per_customer) for k in range(n)]
    return spark.createDataFrame(made, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")


def test_certified_fields_reads_all_orders(spark, tmp_path):
    orders = {"orders": _orders(spark, [1, 6, 7, 70, 130])}
    _agrees(spark, tmp_path, "certified_fields", orders)
    weak = catalogue.queries()["certified_fields"](spark, str(tmp_path)).where("field = 'status'").collect()
    # of seven orders or more the first six have one status, all of them have two
    assert {r.custkey: r.weak_evidence for r in weak} == {0: False, 1: False, 2: False, 3: False, 4: False}


def test_certified_cells_still_reads_six_orders(spark, tmp_path):
    _agrees(spark, tmp_path, "certified_cells", {"orders": _orders(spark, [1, 6, 7, 70])})
