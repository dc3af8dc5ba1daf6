"""Crawling against hand-made pages and a plain walk."""

import random

from pyspark.sql import functions as F

from skein.functions import html as H
from skein.operators import crawl

BASE = "https://shop.example.com/list"


def _pagers(spark, pages):
    rows = spark.createDataFrame([(n, url, html) for n, (url, html) in enumerate(pages)], "id int, url string, html string")
    return [(r.strategy, r.template, r.selector) for r in crawl.pagination(rows, "id", "url", "html").orderBy("id").collect()]


def test_pagination_in_order_of_trust(spark):
    many = '<link rel="next" href="/list?kn=a&amp;ds=30&amp;p=1&amp;spo=30"><a href="/list?p=1&amp;spo=30">2</a><a href="?p=2&amp;spo=60">3</a><a href="/list?p=3">4</a>'
    got = _pagers(
        spark,
        [
            (BASE + "?kn=a", many),
            (BASE, '<link rel="next" href="/list/two">'),
            (BASE, '<a href="/list?page=2&s=1">2</a>'),
            (BASE, '<a href="/list?page=1">1</a>'),
            (BASE, '<a href="/list/page/3/x">3</a>'),
            (BASE, '<div class="swiper"><button aria-label="Next">x</button></div>' + " " * 300 + '<a class="go">Next</a>'),
            (BASE, '<nav aria-label="Pagination"><a href="/1">1</a><a href="/2"> 2 </a></nav>'),
            (BASE, '<div class="pagination big"><a href="/1">1</a><a href="/2">2</a></div>'),
            (BASE, None),
        ],
    )
    assert got[0] == ("url-pattern", "https://shop.example.com/list?kn=a&ds=30&p={N}&spo=30", None)
    assert got[1] == ("url-pattern", "https://shop.example.com/list/two", None)
    assert got[2] == ("url-pattern", "https://shop.example.com/list?page={N}&s=1", None)
    assert got[3] == (None, None, None)
    assert got[4] == ("url-pattern", "https://shop.example.com/list/page/{N}/x", None)
    assert got[5] == ("next-button", None, 'a:has-text("Next"), button:has-text("Next")')
    assert got[6] == ("page-numbers", None, '[aria-label="Pagination"] a')
    assert got[7] == (None, None, None)  # such a bar ends at its first closing tag, which is a link's
    assert got[8] == (None, None, None)


def test_cards(spark):
    card = lambda shop, n: f'<li><a href="/{shop}/product/item-{n}"><img src="x"></a><span>only $ {n}.99</span><a href="/{shop}/product/item-{n}">more</a></li>'
    page = "<html><body><nav><a href='/help/item-9'>help</a></nav><ul>" + "".join(card(s, n) for s in "abc" for n in (1, 2)) + '<li><a href="/d/item-1">no card</a></li></ul><a href="/a/item-7">Option: red</a></body></html>'
    pictures = "<html><body>" + "".join(f'<p><a href="/p/item-{n}"><img></a></p>' for n in range(6)) + "</body></html>"
    rows = spark.createDataFrame([(1, BASE, page), (2, BASE, pictures), (3, BASE, "")], "id int, url string, html string")
    nodes = H.nodes(rows.select("id", "html"), "id", "html").join(rows.select("id", "url"), "id")
    links = crawl.card_links(nodes, "id", "url")
    found = {(r.id, r.url.rsplit(".com", 1)[1], r.carded, r.chrome, r.swatch) for r in links.collect()}
    assert (1, "/a/product/item-1", True, False, False) in found and (1, "/help/item-9", False, True, False) in found
    assert (1, "/a/item-7", False, False, True) in found and (1, "/d/item-1", False, False, False) in found
    groups = {r.id: (r.how, r.shape, r.members, r.carded) for r in crawl.card_groups(links, "id").collect()}
    assert groups == {1: ("priced", "shop.example.com/*/product/*", 6, 6), 2: ("imaged", "shop.example.com/p/*", 6, 6)}


def _plain_walk(rows, cap):
    planned, reports = [], []
    for run in sorted({r[0] for r in rows}):
        seen = set()
        for name in sorted({r[1] for r in rows if r[0] == run}):
            mine = [r for r in rows if r[:2] == (run, name)]
            items, stop, page_one = 0, None, 0
            for number, page in enumerate(sorted({r[2] for r in mine})):
                urls = [r for r in sorted(mine, key=lambda r: (r[2], r[3])) if r[2] == page]
                new, full = 0, False
                for r in urls:
                    if r[4] is None or r[4] in seen:
                        continue
                    if items >= cap:
                        full = True
                        break
                    seen.add(r[4])
                    planned.append(r)
                    items, new = items + 1, new + 1
                page_one += new if number == 0 else 0
                stop = "budget" if full or (new and items >= cap) else None if new else "all-duplicates" if any(r[4] for r in urls) else "empty-page"
                if stop:
                    break
            gained = items - page_one
            reports.append((run, name, items, page_one, stop, stop != "budget" and page_one > 0 and gained < 0.25 * page_one))
    return sorted(planned), sorted(reports, key=repr)


def test_walk_equals_a_plain_walk(spark):
    dice = random.Random(3)
    rows = []
    for run in range(3):
        for name in range(6):
            for page in range(1, 5):
                links = dice.randrange(0, 7)
                rows += [(run, name, page, n, f"u{dice.randrange(25)}") for n in range(links)] or [(run, name, page, 0, None)]
    table = spark.createDataFrame(rows, "run int, input int, page int, pos int, url string")
    # a single look leaves every run to the ordered fold, many looks none
    for looks in (1, 2, 20):
        items, reports = crawl.walk(table, 8, looks=looks)
        got = sorted((r.run, r.input, r.page, r.pos, r.url) for r in items.collect())
        told = sorted(((r.run, r.input, r["items"], r.page_one, r.stop, r.thin) for r in reports.collect()), key=repr)
        assert (got, told) == _plain_walk(rows, 8)
        assert all(r.certifies == (r.gained > 0 and not r.thin) for r in reports.collect())
    few, _ = crawl.walk(table, 8, most_pages=2)
    assert sorted((r.run, r.input, r.page, r.pos, r.url) for r in few.collect()) == _plain_walk([r for r in rows if r[2] <= 2], 8)[0]
    empty, none = crawl.walk(table.limit(0), 8)
    assert empty.count() == none.count() == 0


def test_budgets(spark):
    raws = [None, "x", "{}", '{"max_pages":7,"max_items":9}', '{"max_pages":"all","max_items":"all"}', '{"mode":"all","max_items":2}', '{"max_items":9999}', '{"max_items":-1,"max_pages":1.5}', '{"max_items":"4"}']
    got = spark.createDataFrame([(n, r) for n, r in enumerate(raws)], "n int, raw string").select("n", crawl.budget(F.col("raw")).alias("b")).orderBy("n").collect()
    assert [tuple(r.b) for r in got] == [(3, 50), (3, 50), (3, 50), (7, 9), (10, 5000), (3, 5000), (3, 5000), (3, 50), (3, 50)]


def test_direct_plans_hold_an_address_once_and_stop_at_the_cap(spark):
    inputs = [("a", 1, "u", 2), ("a", 2, None, 2), ("a", 3, "u", 2), ("a", 4, "v", 2), ("a", 5, "w", 2), ("a", 6, "v", 2), ("a", 7, "w", 2), ("b", 1, "u", 2)]
    plan = crawl.plan_direct(spark.createDataFrame(inputs, "run string, input int, url string, cap int"))
    got = {(r.run, r.input): (r.status, r["items"]) for r in plan.collect()}
    assert got == {
        ("a", 1): ("planned", 1), ("a", 2): ("error", 0), ("a", 3): ("planned", 0), ("a", 4): ("planned", 1), ("a", 5): ("skipped_budget", 0), ("a", 6): ("planned", 0), ("a", 7): ("skipped_budget", 0), ("b", 1): ("planned", 1),
    }
