"""Pages and their variants by hand-made cases, empty tables included."""

from pyspark.sql import functions as F

from skein.operators import crawl
from skein.operators import documents as D
from skein.operators import variant_pages as V

TEXTS = "array<string>"


def test_what_an_address_names(spark):
    url = "https://x.io/p?variant=gid://shop/Variant/1234567&Color=Red&utm_source=a#size=6%20x%209"
    got = spark.range(1).select(V.address_variant(F.lit(url)).alias("v")).select("v.*").first()
    assert got.ids == ["1234567"] and [p.key for p in got.pairs] == ["variant", "Color", "size"] and got.labels[0] == "Red"


def test_wrong_variant(spark):
    rows = [
        ("https://x.io/p?color=Red", [], {"color": "dark red"}, [], None),
        ("https://x.io/p?color=Red", [], {"color": "blue"}, [], "color=Red"),
        ("https://x.io/p?color=Red", [], {"size": "L"}, ["blue"], None),
        ("https://x.io/p?sku=1234567", ["7654321"], {}, [], "sku=1234567"),
        ("https://x.io/p?sku=1234567&color=Red", ["7654321"], {"color": "red"}, [], None),
        ("https://x.io/p?sku=1234567", ["7654321"], {}, ["1234567"], None),
        (None, [], {}, [], None),
    ]
    frame = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, url string, ids array<string>, pairs map<string,string>, labels array<string>, want string")
    got = frame.select("n", "want", V.wrong_variant(*map(F.col, ("url", "ids", "pairs", "labels"))).alias("got")).orderBy("n").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_page_steps(spark):
    leaves = spark.createDataFrame([(1, "a[1].x", "v"), (1, "a[11].x", "w"), (1, "b", "z")], "page int, path string, value string")
    chosen = spark.createDataFrame([(1, "a", 1)], "page int, list_path string, item int")
    assert sorted(r.path for r in V.page_twins(leaves, chosen, ["page"]).collect()) == ["a[11].x", "a[1].x", "a[page].x", "b"]
    told = spark.createDataFrame([("a[page].x",), ("b[page]",), ("c",)], "path string").select(V.on_page(F.col("path"), F.lit("a"), F.lit(1)).alias("p")).collect()
    assert [r.p for r in told] == ["a[1].x", None, "c"]


def test_lists_by_kind(spark):
    paths = {
        "json-ld": ["offers[0].price", "offers[1].sku", "other[0].price", "other[1].price", "x.offers[0].price", "x.offers[1].url"],
        "api": ["sold[0].price", "sold[1].price", "skus[0].sku", "skus[1].sku", "skus[1].color", "ids[0].id", "ids[1].id", "ids[1].option1", "ids[0].size", "ids[1].size"],
    }
    leaves = spark.createDataFrame([(1, source, path, "v") for source, all_paths in paths.items() for path in all_paths], "page int, source string, path string, value string")
    got = [(r.source, r.list_path) for r in D.variant_lists(leaves, ["page"]).orderBy("rank").collect()]
    assert got == [("json-ld", "offers"), ("api", "ids"), ("api", "skus")]
    assert D.variant_lists(leaves.limit(0), ["page"]).count() == 0


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "run int, input int, page int, pos int, url string")
    items, reports = crawl.walk(rows, 5)
    assert items.count() == 0 and reports.count() == 0
    pages = spark.createDataFrame([(1, None, None), (2, "no address", '<a href="/x?page=2">2</a>')], "id int, url string, html string")
    assert [r.strategy for r in crawl.pagination(pages, "id", "url", "html").orderBy("id").collect()] == [None, "url-pattern"]
