"""Fields of pages about one thing, by hand-made pages."""

from skein.functions import html as H


def _read(spark, pages, row_path, fields, lists=()):
    rows = spark.createDataFrame(list(enumerate(pages)), "id int, html string")
    return {r.id: r.asDict() for r in H.extract_page(H.nodes(rows, "id", "html"), "id", row_path, fields, lists).collect()}


def test_the_row_first_then_the_page(spark):
    page = (
        '<html><body><h1>Outer</h1><main><h1> Visit the  Inner Store </h1><ul><li>a</li><li>  </li><li>b</li></ul><p></p><p>late</p></main>'
        '<main><h1>Second</h1></main><ol><li>c</li></ol><b class="x">bold</b><a href="/z">z</a><script>{"a":1}</script><i>{"a":1}</i></body></html>'
    )
    fields = {"h": "./h1", "all": ".//li", "empty": "./p", "b": './/b[@class="x"]', "bare": "b", "link": ".//a/@href", "top": "/html/body/h1", "code": ".//script", "json": "i", "gone": "./b", "self": ".", "heads": "//h1"}
    got = _read(spark, [page], "//main", fields, ["all", "heads"])[0]
    assert got["h"] == "Inner" and got["all"] == ["a", "b"] and got["b"] == got["bare"] == "bold" and got["link"] == "/z" and got["top"] == "Outer"
    # the first node decides, even if it is empty; a child of the row is looked for at the top of the page only
    assert got["empty"] is None and got["code"] is None and got["json"] is None and got["gone"] is None and got["self"] is None
    assert got["heads"] == ["Outer", "Inner", "Second"]


def test_pages_without_a_row_or_any_value(spark):
    pages = ["<p>one</p><p>two</p>", "<div></div>", "", None, "<p>Buy now  three</p>"]
    got = _read(spark, pages, "//main", {"p": ".//p", "ps": ".//p", "none": "./p/@id"}, ["ps"])
    assert {n: (r["p"], r["ps"], r["none"]) for n, r in got.items()} == {0: ("one", ["one", "two"], None), 4: ("three", ["three"], None)}
