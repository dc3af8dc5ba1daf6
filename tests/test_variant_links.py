"""Variants certified by links: names, sections and messages by hand-made pages."""

from pyspark.sql import functions as F

from skein.functions import html as H
from skein.operators import variant_links as V

COUNTED = "site string, url string, n int, count int, links array<string>, captured boolean"
BASE = "https://x.io/t/"


def _certify(spark, counted, pages):
    table = spark.createDataFrame([("s", *c) for c in counted], COUNTED)
    html = spark.createDataFrame([(("s", BASE + u), h) for u, h in pages], "at struct<site string, url string>, html string")
    nodes = H.nodes(html, "at", "html").select("at.*", "pos", "tag", "xpath", "attrs")
    chosen, told = V.certify_links(table, nodes, ["site"])
    return [(r.collector, r.fits) for r in chosen.collect()], {r.url.removeprefix(BASE): (r.status, r.message) for r in told.collect()}


def test_sections(spark):
    rows = [
        ("https://x.io/t/a", "https://x.io/t/b", True),
        ("https://x.io/t/a", "https://x.io/T/b", True),
        ("https://x.io/t/a", "https://x.io/u/b", False),
        ("https://x.io/a", "https://x.io/u/b", True),
        ("https://x.io/a", "https://y.io/a", False),
        ("https://x.io:81/a", "https://x.io/a", False),
        ("https://x.io/en-gb/products/a", "https://x.io/en-gb/products/b", True),
        ("https://x.io/en-gb/products/a", "https://x.io/en-gb/help/b", False),
        ("https://x.io/en/a", "https://x.io/en/b", True),
        ("https://x.io/ip/shoes/1", "https://x.io/ip/2", True),
        ("https://x.io/t/a", "https://x.io/", False),
        ("x", "https://x.io/t", False),
        (None, "https://x.io/t", False),
        ("https://x.io/t/a", None, False),
    ]
    table = spark.createDataFrame(rows, "page string, link string, want boolean")
    assert table.where(V.likely_variant(F.col("page"), F.col("link")) != F.col("want")).collect() == []


def test_names_of_elements(spark):
    attrs = {"id": "pick", "class": " row  swatches js-x it's swatches", "aria-label": "Colours"}
    got = spark.range(1).select(V._names(F.create_map(*[F.lit(x) for kv in attrs.items() for x in kv])).alias("n")).first().n
    assert got == ["//*[@id='pick']//a/@href", "//*[contains(concat(' ', normalize-space(@class), ' '), ' swatches ')]//a/@href", "//*[@aria-label='Colours']//a/@href"]


def test_one_place_reads_the_links_of_all_pages(spark):
    link = lambda *names: "".join(f'<a href="{n}">x</a>' for n in names)
    page = lambda inner, also="": f'<html><body id="b"><div class="opts col-2">{inner}</div>{also}{link("/help/x", "/t/other")}</body></html>'
    counted = [
        (BASE + "1", 1, 2, [BASE + "1r#top", BASE + "1g", "https://x.io/help/x"], True),
        (BASE + "2", 2, 1, [BASE + "2r", BASE + "2r"], True),
        (BASE + "3", 3, 0, None, True),
        (BASE + "4", 4, 2, [BASE + "4r", BASE + "4g"], True),
        (BASE + "5", 5, 2, [BASE + "5r", BASE + "5g"], True),
        (BASE + "6", 6, 1, ["https://x.io/help/x"], True),
        (BASE + "7", 7, 3, [BASE + "7r"], False),
        (BASE + "8", 8, 1, [BASE + "8r"], True),
        (BASE + "9", 9, 0, [], True),
    ]
    pages = [
        ("1", page(link("1r", "/t/1g", "1g#a", "javascript:x", "#"))), ("2", page(link("/t/2r"))), ("3", page("")), ("4", page(link("4r", "4x"))),
        ("5", page(link("5r", "5g", "5z"))), ("6", page("")), ("8", page("")), ("9", page(link("9r"))),
    ]
    chosen, told = _certify(spark, counted, pages)
    assert chosen == [("//*[contains(concat(' ', normalize-space(@class), ' '), ' opts ')]//a/@href", 3)]
    assert told == {
        "1": ("ok", None), "2": ("ok", None), "3": ("none", None), "4": ("failed", "found 1 of 2 variants on product 4"), "5": ("failed", "found 3 variants on product 5, expected 2"),
        "6": ("failed", "found no variants on product 6"), "7": ("not_captured", None), "8": ("failed", "found no variants on product 8"), "9": ("failed", "product 9 lists 1 variants — confirm them"),
    }


def test_no_variants_no_names_and_empty_tables(spark):
    chosen, told = _certify(spark, [(BASE + "1", 1, 0, [], True), (BASE + "2", 2, 0, None, False)], [("1", '<p id="a"><a href="/t/x">x</a></p>')])
    assert chosen == [] and told == {"1": ("none", None), "2": ("not_captured", None)}
    chosen, told = _certify(spark, [(BASE + "1", 1, 1, [BASE + "x"], True), (BASE + "2", 2, 0, None, True)], [("1", '<p><a href="/t/x">x</a></p>')])
    assert chosen == [] and told == {"1": ("failed", "found no variants on product 1"), "2": ("none", None)}
    chosen, told = _certify(spark, [], [])
    assert chosen == [] and told == {}


def test_a_page_is_told_in_its_own_row(spark, sf_dir, monkeypatch):
    """Neither elements nor links are stored or moved: one table with a row a page is all that stays."""
    from skein.plans import proofs

    stored = []
    monkeypatch.setattr(V, "materialise", lambda df, name: stored.append((name, df.columns)) or df)
    told = proofs.link_messages(spark, sf_dir)
    assert stored == [("page-links", ["o_custkey", "url", "n", "count", "captured", "wanted", "candidates", "reads"])]
    assert "Broadcast" not in told._jdf.queryExecution().executedPlan().toString()


def test_pages_read_together_are_the_node_table(spark):
    """With the page's address: the same elements, those with attributes, a row a page."""
    pages = ['<html lang="en"><body class="a b"><a href=" ../x?y#z ">l</a><A HREF=/p/1#t>m</A><p>n<img src="i" alt=\'"\'><td id="">', "", None, "<b>no attributes</b>", '<a name="x" href="/q/&amp;r"><div class="c"']
    frame = spark.createDataFrame([(n, h, f"https://x.io/t/{n}") for n, h in enumerate(pages)], "id int, html string, url string")
    told = {r.id: [(e.tag, e.xpath, e.attrs) for e in r.nodes] for r in H.nodes(frame, "id", "html", "url").collect()}
    want = {n: [] for n in range(len(pages))}
    for r in H.nodes(frame, "id", "html").orderBy("pos").collect():
        want[r.id] += [(r.tag, r.xpath, r.attrs)] if r.attrs else []
    assert {n: sorted(e, key=str) for n, e in told.items()} == {n: sorted(e, key=str) for n, e in want.items()}
    joined = [a for r in H.nodes(frame, "id", "html", "url").collect() for a in [e.address for e in r.nodes if e.tag == "a"]]
    assert sorted(joined) == ["https://x.io/p/1#t", "https://x.io/q/&r", "https://x.io/x?y#z"]


def test_plain_tags_are_read_as_by_the_parser_itself(monkeypatch):
    import itertools
    from html.parser import HTMLParser

    bits = ['<div class="a b">', '<a href="/x">', '<a href="/x&amp;y">', "<p id='x'>", "<td id=y>", '<main  id="m">', '<script src="s">', "</script>", '<li id="l"/>', "<B>", "</a>", "t&lt;", '<h1 a="<">', "<", '<p class="c"']
    texts = ["".join(b) for b in itertools.product(bits, repeat=3)]
    fast = [list(H._nodes_of(t)) for t in texts]
    monkeypatch.setattr(H._Nodes, "parse_starttag", HTMLParser.parse_starttag)
    monkeypatch.setattr(H._Nodes, "updatepos", HTMLParser.updatepos)
    assert fast == [list(H._nodes_of(t)) for t in texts]


def test_addresses_from_the_root_are_joined_as_by_the_library():
    from urllib.parse import urljoin

    from skein.functions.urls import joined_url

    for base in ("https://x.io/a/b", "http://X.io:81/", "https://x.io", "HTTPS://x.io/a", "https://x.io/a?b", "", "x"):
        for url in ("/", "/p/1#top", "/p/1#", "/a//b/", "//y.io/a", "/a/../b", "/a/.", "/a?", "/a?b", "/a;b", "/é", "/a b", "x", "#", "", "/%41", "/a:b", "/a\n"):
            assert joined_url(url, base) == urljoin(base, url)
