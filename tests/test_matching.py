"""Matches, documents and redaction on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from skein.functions import json_leaves, redaction
from skein.operators import documents as D
from skein.operators import matching as M


def value(spark, column, **cells):
    frame = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells)) if cells else spark.range(1)
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize("key", ["apiKey", "X-Auth-Token", "DB_PASSWORD", "client_secret", "accesstoken", "sessionId"])
def test_secret_keys(spark, key):
    assert value(spark, redaction.is_secret_key(F.col("k")), k=key)


@pytest.mark.parametrize("key", ["signal", "design", "passed", "bypass", "dedupeKey", "tokenCount", "passwordLength", "sessions", ""])
def test_other_keys(spark, key):
    assert not value(spark, redaction.is_secret_key(F.col("k")), k=key)


@pytest.mark.parametrize(
    "text, masked",
    [
        ("https://user:pw@host/a?token=abc&b=1", "https://***@host/a?token=***&b=1"),
        ('{"password": "x\\"y", "n": 1}', '{"password": "***", "n": 1}'),
        ("Authorization: Bearer abcdef123456", "Authorization: Bearer ***"),
        ("api_key = 'k1', size=3", "api_key = ***, size=3"),
        ("tokenCount=5 design=x", "tokenCount=5 design=x"),
    ],
)
def test_redacted_text(spark, text, masked):
    assert value(spark, redaction.redact_text(F.col("t")), t=text) == masked


def test_redacted_maps_and_placeholders(spark):
    got = value(spark, redaction.redact_map(F.create_map(F.lit("apiKey"), F.lit("k"), F.lit("note"), F.lit("secret=1x"))))
    assert got == {"apiKey": "***", "note": "secret=***"}
    assert [value(spark, redaction.is_placeholder(F.col("a")), a=a) for a in ("N/A", " — ", "--", "not found", "nothing")] == [True, False, True, True, False]


def test_first_hit_takes_capture_order(spark):
    rows = [(1, 0, "https://x/a?1", '{"b": ""}'), (1, 1, "https://x/b?2", '{"b": "v", "c": [{"d": 5}]}'), (1, 2, "https://x/c", '{"b": "w"}'), (1, 3, "https://x/d", "{")]
    found = M.first_hit(spark.createDataFrame(rows, "page int, seq int, url string, body string"), ["b", "c[0].d", "zz"], ["page"])
    assert {r.path: (r.value, r.response) for r in found.collect()} == {"b": ("v", "https://x/b"), "c[0].d": ("5", "https://x/b")}


def test_page_variant_rules(spark):
    strings, pairs = "array<string>", "map<string,string>"
    rows = [
        ("id", ["77"], {}, [], True),
        ("pair", [], {"color": "red"}, [], True),
        ("contradicted", [], {"color": "blue"}, ["M"], False),
        ("label", [], {}, ["m"], True),
        ("none", [], {}, ["xl"], False),
    ]
    frame = spark.createDataFrame(rows, f"name string, ids {strings}, pairs {pairs}, labels {strings}, want boolean")
    page = [F.array(F.lit("77")), F.create_map(F.lit("color"), F.lit("red")), F.array(F.lit("M"))]
    matches = M.entry_matches(F.col("ids"), F.col("pairs"), F.col("labels"), *page)
    assert {r.name: r.m for r in frame.select("name", matches.alias("m")).collect()} == {r[0]: r[4] for r in rows}
    assert M.page_entry(frame.withColumn("p", F.lit(1)), ["p"], matches).count() == 0  # several match
    assert M.page_entry(frame.where("name IN ('id', 'none')").withColumn("p", F.lit(1)), ["p"], matches).first().name == "id"


def test_reconciled_rows_follow_the_group(spark):
    rows = spark.createDataFrame([("l", "https://x.io/p/b-2?c=1", 0), ("l", "https://x.io/p/z-9", 1), ("l", "https://x.io/p/b-2?c=2", 2)], "page string, url string, place int")
    group = spark.createDataFrame([("l", "https://x.io/p/a-1", 0), ("l", "https://www.x.io/p/b-2", 1)], "page string, url string, place int")
    got = [(r.url.rsplit("/", 1)[1], r.added) for r in M.reconcile_rows(rows, group, ["page"], "url").orderBy("rank").collect()]
    assert got == [("a-1", True), ("b-2?c=1", False), ("b-2?c=2", False), ("z-9", False)]


def test_pagers(spark):
    frame = spark.createDataFrame([(1, "https://x/s?offset=0&page=2&q=a", 30)], "e int, url string, n int")
    got = [(r.param, r.start, r.step) for r in M.pager_candidates(frame, ["e"], "n").orderBy("rank").collect()]
    assert got == [("page", 2, 1), ("page", 2, 30), ("offset", 0, 30), ("offset", 0, 1)]
    assert value(spark, M.probe_url(F.col("u"), F.lit("page"), F.lit(3)), u="https://x/s?offset=0&page=2&q=a") == "https://x/s?offset=0&page=3&q=a"
    assert value(spark, M.overlap_share(F.array(*map(F.lit, "abbc")), F.array(*map(F.lit, "bcd")))) == pytest.approx(2 / 3)


def test_row_urls_stay_in_the_first_page_directory(spark):
    seen = spark.createDataFrame([("l", "https://x.io/shop/p/1"), ("l", "https://x.io/shop/q/22")], "page string, url string")
    shape = M.page1_shape(seen, ["page"], "url")
    assert [(r.origins, r.path_prefix) for r in shape.collect()] == [(["https://x.io"], "/shop/")]
    urls = spark.createDataFrame([("l", "https://x.io/shop/r/3"), ("l", "https://x.io/cart"), ("l", "https://y.io/shop/p/1")], "page string, url string")
    got = urls.join(shape, "page").select(M.fits_page1(F.col("url"), F.col("origins"), F.col("path_prefix")).alias("ok")).collect()
    assert [r.ok for r in got] == [True, False, False]


def test_guarded_rows(spark):
    shape = M.page1_shape(spark.createDataFrame([("l", "https://x.io/shop/p/1"), ("l", "https://x.io/shop/q/22")], "list string, url string"), ["list"], "url")
    raws = ["https://x.io/shop/r/3", "/shop/z", "r/9", "", None, "887766", "https://y.io/shop/p/1", "/api/1", "../shop/k", "HTTPS://X.io/shop/u", "javascript:x/y"]
    rows = [("l", 2, n, raw, "https://x.io/shop/list") for n, raw in enumerate(raws)] + [("l", 3, 0, "/shop/a", "https://x.io/shop/list"), ("none", 2, 0, "/shop/a", "https://x.io/"), ("l", 4, 0, None, "https://x.io/")]
    table = spark.createDataFrame(rows, "list string, page int, pos int, raw string, base string")
    kept, report = M.guarded_rows(table, shape, ["list"], ["page"], "raw", "base", "pos")
    assert kept.columns == table.columns
    assert sorted((r.list, r.page, r.raw) for r in kept.collect()) == [("l", 2, "../shop/k"), ("l", 2, "/shop/z"), ("l", 2, "HTTPS://X.io/shop/u"), ("l", 2, "https://x.io/shop/r/3"), ("l", 2, "r/9"), ("l", 3, "/shop/a")]
    assert {(r.list, r.page): (r.usable, r.refused) for r in report.collect()} == {("l", 2): (5, "887766"), ("l", 3): (1, None), ("none", 2): (0, "/shop/a")}
    kept, report = M.guarded_rows(table.limit(0), shape, ["list"], ["page"], "raw", "base", "pos")
    assert kept.count() == report.count() == 0


BODY = {
    "@type": "ProductGroup",
    "name": "Chair",
    "hasVariant": [{"sku": "s1", "color": "red", "offers": {"price": "$1,200"}, "image": ["i1"]}, {"mpn": "m2", "size": "L", "offers": {"price": 5}}],
    "related": [{"name": "x", "url": "u"}, {"name": "y", "url": "v"}],
}


def leaves(spark, body, **keys):
    rows = [(1, "json-ld", json.dumps(body))]
    return json_leaves.leaf_table(spark.createDataFrame(rows, "page int, source string, body string"), ["page", "source"], "body", json_leaves.CANDIDATES)


def test_variant_lists_and_groups(spark):
    table = leaves(spark, BODY)
    assert [(r.list_path, r.entries) for r in D.variant_lists(table, ["page"]).collect()] == [("hasVariant", 2)]
    got = {r.item: (r.sku, r.price, r.image_url, r.color, r.size) for r in D.product_group_variants(table, ["page"]).collect()}
    assert got == {0: ("s1", 1200.0, "i1", "red", None), 1: ("m2", 5.0, None, None, "L")}


def _entity(spark, body):
    rows = spark.createDataFrame([(1, body if isinstance(body, str) or body is None else json.dumps(body))], "page int, body string")
    found = D.entity_subtree(json_leaves.leaf_table(rows, ["page"], "body", json_leaves.ENTITIES), ["page"]).collect()
    return [(r.path, r.score) for r in found]


def test_entity_subtree_prefers_the_selected(spark):
    body = {"a": {"name": "n", "price": 1, "sku": "s", "brand": "b"}, "selectedItem": {"itemName": "n", "prices": 1, "sku": "s"}, "c": {"id": 1}}
    assert _entity(spark, body) == [("selectedItem", 3)]
    del body["selectedItem"]["sku"], body["selectedItem"]["prices"]
    assert _entity(spark, body) == [("a", 4)]


def test_entity_subtree_counts_keys_of_all_objects_above(spark):
    # keys that hold objects, lists, nulls or nothing count for the object they stand in
    assert _entity(spark, {"x": {"brand": {"id": 1}, "reviews": [], "rating": None, "sizes": {}}}) == [("x", 4)]
    # an entry of a list is not under the key of the list, and of equals the first in the document wins
    assert _entity(spark, {"one": {"name": 1, "price": 2}, "selected": [{"name": 1, "price": 2}]}) == [("one", 2)]
    assert _entity(spark, {"name": 1, "price": {"name": 1, "price": 2}}) == [("", 2)]
    assert _entity(spark, {"name": 1, "productName": 2}) == [("", 2)]
    # past twenty entries and twelve levels nothing is looked at
    assert _entity(spark, {"rows": [{"name": n} for n in range(20)] + [{"name": 1, "price": 2}]}) == []
    deep = {"name": 1, "price": 2}
    for _ in range(12):
        deep = {"k": deep}
    assert _entity(spark, deep) == [(".".join(["k"] * 12), 2)]
    assert _entity(spark, {"k": deep}) == []
    for none in (None, "", "no json", "[]", "1", {}):
        assert _entity(spark, none) == []


def test_page_shapes(spark):
    pages = spark.createDataFrame([(1, "https://x.io/p/12?b=1&a=2"), (2, "https://x.io/")], "page int, url string")
    got = {r.page: (r.pattern, r.types, r.offers, r.rating) for r in D.page_shapes(pages, leaves(spark, BODY | {"aggregateRating": {"ratingValue": "4.5"}}), ["page"], "url").collect()}
    assert got == {1: ("/p/n?a&b", ["ProductGroup"], "in-variants", True), 2: ("/", [], "none", False)}


def test_catalogue_keeps_what_resolves(spark):
    entries = spark.createDataFrame([(1, "name", False), (1, "gone", False), (1, "old", True)], "page int, path string, used boolean")
    assert sorted(r.path for r in D.resolvable(entries, leaves(spark, BODY), ["page"]).collect()) == ["name", "old"]
