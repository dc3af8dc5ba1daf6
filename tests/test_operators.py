"""Dataset operators on small hand-made tables."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from skein.functions import json_leaves
from skein.operators import cells, certify, contract, export, extract, pages, quality, queue, ranking, relational, reports, variants
from skein.sources import tables


def test_mechanical_extraction_prefers_rule_then_depth(spark):
    body = {"product": {"name": "Chair", "deep": {"name": "No"}}, "offers": {"price": 5}, "title": "T"}
    leaves = json_leaves.leaf_table(spark.createDataFrame([(1, "api", json.dumps(body)), (1, "meta", '{"og:title": "M", "brand": "B"}')], "page int, pool string, body string"), ["page", "pool"], "body", json_leaves.FLATTEN)
    found = extract.mechanical(leaves, ["page"], extract.alias_table(spark, ["product_name", "price", "brand", "sku"]))
    got = {r.field: (r.value, r.path, r.source) for r in found.collect()}
    assert got == {"product_name": ("T", "title", "api"), "price": ("5", "offers.price", "api"), "brand": ("B", "brand", "meta")}


def test_chain_takes_the_first_valid_tier(spark):
    rows = [(1, "price", 3, 0, "9", True), (1, "price", 1, 0, None, True), (1, "price", 2, 1, "7", False), (1, "price", 2, 0, "8", False)]
    candidates = spark.createDataFrame(rows, "page int, field string, tier int, place int, value string, stored boolean")
    best = extract.first_tier(candidates, ["page"], F.col("value").isNotNull()).first()
    assert (best.value, best.tier) == ("8", 2)
    assert [r.tier for r in extract.rejected(candidates, F.col("value").isNotNull()).collect()] == [1]


def test_identifiers_and_same_page(spark):
    ids = lambda t: extract.identifiers(F.lit(t))
    frame = spark.range(1).select(
        extract.describes_same_page(F.lit("Product"), ids("sku abc12345"), ids("/p/zzz98765")).alias("other"),
        extract.describes_same_page(F.lit("Product"), ids("none"), ids("/p/zzz98765")).alias("unknown"),
        extract.describes_same_page(F.lit("Organization"), ids("abc12345"), ids("zzz98765")).alias("untyped"),
    ).first()
    assert not frame.other and frame.unknown and frame.untyped


def test_agreement_confidence(spark):
    rows = [("a", 1, "X", 0.9), ("a", 2, "x", 0.5), ("a", 3, "y", 0.5), ("b", 1, "q", 0.4)]
    got = {r.field: (r.value, round(r.confidence, 3)) for r in extract.agreement_confidence(spark.createDataFrame([(1, *r) for r in rows], "page int, field string, rank int, value string, confidence double"), ["page"]).collect()}
    assert got == {"a": ("X", 0.667), "b": ("q", 0.4)}


def test_catalogue_caps_and_one_display(spark):
    rows = [(1, f"l{n}", f"p{n}", "v" * (200 if n == 0 else 3), n > 4, n) for n in range(12)] + [(1, "l1", "dup", "v", True, 50), (1, "", "p", "v", True, 51)]
    got = extract.catalogue(spark.createDataFrame(rows, "c int, label string, path string, sample_value string, displayed boolean, place int"), ["c"]).collect()
    assert len(got) == 8 and sum(r.displayed for r in got) == 1 and max(len(r.sample_value) for r in got) == 161


def _evaluated(spark, table, absent=(), default=()):
    """table: path -> {url: raw}; every page expects 'v'."""
    urls = sorted({u for reads in table.values() for u in reads})
    readings = [("f", u, p.split(":")[0], p.split(":")[1], raw) for p, reads in table.items() for u, raw in reads.items()]
    cells_ = [("f", u, "v", u in absent, u in default) for u in urls]
    return certify.evaluate(
        spark.createDataFrame(readings, "field string, url string, source string, path string, raw string"),
        spark.createDataFrame(cells_, "field string, url string, expected string, absent boolean, default_cell boolean"),
        F.col("raw") == F.col("expected"),
    )


def test_certify_one_layout(spark):
    table = {"api:a.b": {"1": "v", "2": "v"}, "xpath:/x": {"1": "v", "2": "v"}, "meta:m": {"1": "v", "2": "w"}, "api:a.b.c": {"1": "v", "2": "v"}, "api:a": {"1": "v", "2": "v"}}
    got = [(r.path, r.how) for r in certify.certify(_evaluated(spark, table)).orderBy("place").collect()]
    assert got == [("a", "layout"), ("/x", "layout"), ("a.b", "layout")]


def test_certify_cover_needs_a_common_path(spark):
    table = {"api:a": {"1": "v", "2": "v", "3": None}, "meta:m": {"1": None, "2": None, "3": "v"}, "api:bad": {"1": "v", "2": "v", "3": "w"}}
    evaluated = _evaluated(spark, table)
    got = [(r.path, r.how) for r in certify.certify(evaluated).orderBy("place").collect()]
    assert got == [("a", "cover"), ("m", "cover")]
    results = {r.url: r.result for r in certify.cell_results(evaluated, certify.certify(evaluated)).collect()}
    assert results == {"1": "pass", "2": "pass", "3": "pass"}
    lonely = {"api:a": {"1": "v", "2": None}, "meta:m": {"1": None, "2": "v"}}
    assert certify.certify(_evaluated(spark, lonely)).count() == 0


def test_absent_pages_must_read_nothing(spark):
    table = {"api:a": {"1": "v", "2": "v", "3": "x"}, "meta:m": {"1": "v", "2": "v", "3": None}}
    assert [r.path for r in certify.certify(_evaluated(spark, table, absent={"3"})).collect()] == ["m"]


def test_response_groups_are_transitive(spark):
    reads = [("a", "u1", "r1"), ("b", "u1", "r1"), ("b", "u2", "r2"), ("c", "u2", "r2"), ("d", "u2", "r9")]
    got = {r.path: r.group for r in certify.response_groups(spark.createDataFrame(reads, "path string, url string, response string")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d"}


def test_response_groups_follow_long_chains(spark):
    reads = [(f"p{n:02}", f"u{n + k}", "r") for n in range(50) for k in (0, 1)] + [("z", "u99", "r")]
    got = {r.path: r.group for r in certify.response_groups(spark.createDataFrame(reads, "path string, url string, response string")).collect()}
    assert got == {f"p{n:02}": "p00" for n in range(50)} | {"z": "z"}


@pytest.mark.parametrize(
    "flags, kind",
    [
        ([("own", True, True, True, True)] * 2, "other-layout"),
        ([("own", True, True, False, True)] * 2 + [("new", False, False, True, True)] * 2, "moved"),
        ([("own", True, True, False, True)] * 2, "changed"),
        ([("own", True, True, False, False)] * 2, "lost"),
    ],
)
def test_drift_classes(spark, flags, kind):
    rows = [("f", f"p{n}", *f) for n, f in enumerate(flags)]
    frame = spark.createDataFrame(rows, "field string, url string, path string, certified_path boolean, fits boolean, equal boolean, reads boolean")
    assert certify.drift_class(frame).first().drift == kind


def test_refresh_is_all_or_nothing(spark):
    schema = "field string, url string, was string, now string, by_nature boolean, same_place boolean, fixed_variant boolean, shown boolean, in_range boolean"
    ok = (True, True, False, True, True)
    rows = [("a", "1", "x", "y", *ok), ("a", "2", "x", "x", *ok), ("b", "1", "x", "y", *ok), ("c", "1", "x", "", *ok), ("c", "2", "x", "y", *ok), ("d", "1", "x", "y", True, True, False, None, False), ("d", "2", "x", "y", *ok)]
    got = {r.field: (r.refusal, r.changed) for r in certify.refresh_plan(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": (None, 1), "b": ("too-few-pages", 1), "c": ("empty", 2), "d": ("out-of-range", 2)}


def test_lean_pages_switch(spark):
    rows = [("r", n, "f", lean, full) for n, (lean, full) in enumerate([("a", "a"), (None, "b"), (None, "b"), (None, "b"), ("a", "a")])]
    got = [r.full_mode for r in certify.lean_agreement(spark.createDataFrame(rows, "run string, n int, field string, lean string, full string"), "run", ["n"]).orderBy("n").collect()]
    assert got == [False, False, False, True, True]


def test_requests_rank_products_over_config(spark):
    body = lambda *keys: json.dumps({k: "x" * 300 for k in keys})
    rows = [
        (1, 0, "https://x.io/api/config", body("featureFlags", "layout", "zones")),
        (1, 1, "https://x.io/api/product/1", body("name", "price", "sku")),
        (1, 2, "https://x.io/api/related", body("name", "price", "sku")),
        (1, 3, "https://cdn.onetrust.com/product", body("name", "price", "sku")),
        (1, 4, "https://x.io/api/ok", '{"success": true}'),
    ]
    got = ranking.rank_requests(spark.createDataFrame(rows, "page int, seq int, url string, body string"), ["page"]).collect()
    assert [r.seq for r in got] == [1]


def test_listing_api(spark):
    arrays = [("l", "r1", "items", str(i)) for i in range(6)] + [("l", "r2", "ads", str(i)) for i in range(2)]
    urls = [("l", str(i)) for i in range(8)]
    best = pages.listing_api(spark.createDataFrame(arrays, "page string, response string, array_path string, identifier string"), spark.createDataFrame(urls, "page string, identifier string"), ["page"]).first()
    assert (best.response, best.array_path, best.matched, best.covered) == ("r1", "items", 6, 0.75)


def test_quality_checks(spark):
    check = lambda f, raw: spark.createDataFrame([(raw,)], "a string").select(f(F.col("a")).alias("x")).first().x
    severities = lambda x: [i.severity for i in x.issues]
    assert check(quality.number, "star-rating Three").value == "3.0"
    assert severities(check(quality.price, "$0")) == ["warning", "warning"] and severities(check(quality.price, "n/a")) == ["error"]
    assert check(quality.string, "a<br/>b").value == "a b" and severities(check(quality.string, "<p></p>")) == ["error"]
    assert severities(check(quality.url, " http://x.io/a ")) == ["warning"] and severities(check(quality.url, "x")) == ["error"]
    assert check(quality.boolean, "No").value == "false" and check(quality.boolean, None).issues == []
    far = spark.range(1).select(quality.date(F.lit("2030-01-01"), F.lit("2024-01-01").cast("date")).alias("x")).first().x
    assert severities(far) == ["warning"]
    assert spark.range(1).select(quality.list_items(F.array(F.lit("<b>a</b>"), F.lit("<br/>"))).alias("x")).first().x == ["a"]


def test_merge_keeps_filled_cells(spark):
    parent = spark.createDataFrame([(1, "a", ""), (2, None, "b"), (3, None, None)], "id int, x string, y string")
    child = spark.createDataFrame([(1, "z", "new"), (2, "new", "z"), (9, "z", "z")], "id int, x string, y string")
    got = {r.id: (r.x, r.y, r.filled_fields, r.absent_fields) for r in cells.merge_backfill(parent, child, ["id"], ["x", "y"]).collect()}
    assert got == {1: ("a", "new", ["y"], []), 2: ("new", "b", ["x"], []), 3: (None, None, [], ["x", "y"])}


def test_variant_keys(spark):
    row = spark.createDataFrame([("", "g1", "https://x/1#a", "red", None)], "sku string, gtin string, url string, color string, size string")
    key = lambda *a: row.select(variants.variant_key(*a).alias("x")).first().x
    axes = [F.col("color"), F.col("size")]
    assert key(F.col("sku"), F.col("gtin"), None, axes) == "g1"
    assert key(F.col("sku"), None, F.col("url"), axes) == "https://x/1"
    assert key(F.col("sku"), None, None, axes) == "red · "


def test_names_and_contract(spark):
    assert export.unique_names(["a", "a", "a (2)", "b"]) == ["a", "a (2)", "a (2) (2)", "b"]
    c = contract.Contract((contract.Field("title", "Title", concept="product_name"), contract.Field("price", "Price", "money", "price")))
    c = c.add("List  Price!", "money").rename("title", "Name")
    assert [f.key for f in c.fields] == ["title", "price", "list_price"] and c.fields[1].effective_level == "variant"
    frame = c.select(spark.createDataFrame([(1, "x")], "extra int, title string"))
    assert frame.columns == ["title", "price", "list_price", "extra"]
    assert contract.derive_key("List price", ["list_price"]) == "list_price_2"
    assert c.schema()["price"].dataType.simpleString() == "decimal(18,2)"


def test_files(spark, tmp_path):
    frame = spark.createDataFrame([(1, 'a,"b"', 2.0), (2, None, 2.5)], "id int, name string, price double").coalesce(1)
    export.write_csv(frame, str(tmp_path / "csv"), ["id"])
    header = next((tmp_path / "csv/header").glob("*.txt")).read_bytes().decode()
    body = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "csv").glob("*.txt")))
    assert header == "﻿id,name,price\r\n" and body == '1,"a,""b""",2\r\n2,,2.5\r\n'
    for name, some in (("some", frame.repartition(3)), ("none", frame.where("id > 9"))):
        export.write_json_envelope(some, str(tmp_path / name), {"id": "r"}, None, ["id"])
        folders = [tmp_path / name / "head", tmp_path / name, tmp_path / name / "tail"]
        envelope = json.loads("".join(p.read_text() for f in folders for p in sorted(f.glob("*.txt"))))
        assert envelope["fields"] == ["id", "name", "price"] and len(envelope["rows"]) == some.count()
        assert name == "none" or envelope["rows"][1] == {"id": 2, "name": None, "price": 2.5}
    assert export.write_xlsx(frame, str(tmp_path / "x"), {"price": "money"}) == 2
    sheet = zipfile.ZipFile(tmp_path / "x/part-00000-000.xlsx").read("xl/worksheets/sheet1.xml").decode()
    assert "<c><v>2.0</v></c>" in sheet and "a,\"b\"" in sheet.replace("&quot;", '"') and sheet.count("<row>") == 3
    assert export.write_xlsx(frame, str(tmp_path / "y"), most_rows=1) == 2 and len(list((tmp_path / "y").glob("*.xlsx"))) == 2
    assert export.write_xlsx(frame.where("id > 9"), str(tmp_path / "z")) == 0 and len(list((tmp_path / "z").glob("*.xlsx"))) == 1
    (tmp_path / "in.csv").write_bytes(b'a,b\r\n"x ""y""\nz",1\r\n ,\r\nq,2\r\n')
    assert [(r.a, r.b) for r in tables.csv_rows(spark, str(tmp_path / "in.csv")).collect()] == [('x "y"\nz', "1"), ("q", "2")]


def test_captures(spark, tmp_path):
    line = {"url": "https://x.io/", "html": "<p>", "requests": [{"url": "u", "is_json": True, "body": "{\"a\": 1}"}, {"url": "v", "is_json": True, "body": "{"}]}
    (tmp_path / "c.json").write_text(json.dumps(line) + "\n{broken\n")
    captured = tables.captures(spark, str(tmp_path / "c.json"))
    assert captured.count() == 2
    assert [(r.seq, r.url) for r in tables.json_requests(captured.where("url IS NOT NULL"), []).select("seq", "url").collect()] == [(0, "u")]


def test_claim_changes_only_the_picked(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    schema = "id int, queue string, type string, key string, status string, attempts int, locked_by string, locked_until timestamp, started_at timestamp, progress_at timestamp"
    jobs = spark.createDataFrame([(1, "q", "t", None, "queued", 0, None, None, None, None), (2, "q", "t", None, "queued", 0, None, None, None, None)], schema)
    got = {r.id: (r.status, r.attempts, r.started_at is not None) for r in queue.claimed(jobs, jobs.where("id = 2"), "w", 60, now).collect()}
    assert got == {1: ("queued", 0, False), 2: ("running", 1, True)}


def test_small_sides_are_checked(spark):
    tiny, large = spark.range(10), spark.range(10_000_000_000)
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "broadcast" in plan(relational.small(tiny)).lower() and "broadcast" not in plan(relational.small(large)).lower()


def test_path_conflicts(spark):
    rows = [("a", "10", "u"), ("a", "10.2", "u"), ("b", "10", "u"), ("b", "20", "u"), ("c", "10", "u"), ("c", "20", "w")]
    frame = spark.createDataFrame([(f, v, u, False) for f, v, u in rows], "field string, last_value string, last_url string, protected boolean")
    assert [r.field for r in reports.path_conflicts(frame, ["field"]).collect()] == ["b"]


def test_empty_tables(spark):
    cells_ = spark.createDataFrame([], "item int, field string, value string")
    assert cells.coverage(cells_, F.lit(False)).count() == 0 and cells.drifted(cells_).count() == 0
    assert cells.field_coverage(cells_, ["item"]).first().field_coverage == 0.0
