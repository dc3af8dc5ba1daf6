"""Queries of the crawl family: pagination, cards, walks, listing responses, and what pages say about themselves."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import html as H
from skein.functions import json_leaves as J
from skein.functions import names as N
from skein.functions import shape as S
from skein.functions import text as T
from skein.functions import urls as U
from skein.operators import cells as CELLS
from skein.operators import crawl as C
from skein.operators import documents as DOC
from skein.operators import export as X
from skein.operators import extract as E
from skein.operators import matching as M
from skein.operators import pages as P
from skein.operators import reports
from skein.operators import variant_pages as VP
from skein.sources import tables
from skein.sources.tables import parts_of, spread, table
from skein.streaming import windows

from .pages import _LINKS, _PARTS, _SHAPED, _links


def pagination(spark, folder):
    """How pages lead on, with a pager of another kind behind each: numbered addresses, a declared next page, a button, a bar."""
    n = F.col("page_id")
    pager = (
        F.when(n % 5 == 0, F.concat(F.lit('<a href="/x?page='), n.cast("string"), F.lit('">on</a>')))
        .when(n % 5 == 1, F.concat(F.lit('<link rel="next" href="?p='), n.cast("string"), F.lit('">')))
        .when(n % 5 == 2, F.lit('<a class="go" rel="next">on</a>'))
        .when(n % 5 == 3, F.lit('<nav aria-label="All pagination"><a href="/1">1</a><a href="/2">2</a></nav>'))
        .otherwise("")
    )
    found = C.pagination(table(spark, folder, "pages").withColumn("html", F.concat("html", pager)), "page_id", "url", "html")
    return found.select("page_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("strategy", "template", "selector")])


PAGINATION = _PARTS + rf"""
, g AS (SELECT *, regexp_matches(right(html, 200), '{C.GALLERY}') AS gallery FROM s)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN CASE WHEN page_id > 1 THEN 'url-pattern' ELSE '' END WHEN 1 THEN 'url-pattern' WHEN 2 THEN CASE WHEN gallery THEN '' ELSE 'next-button' END WHEN 3 THEN 'page-numbers' ELSE '' END AS strategy,
  CASE page_id % 5 WHEN 0 THEN CASE WHEN page_id > 1 THEN scheme || '://' || host || '/x?page={{N}}' ELSE '' END WHEN 1 THEN scheme || '://' || host || path || '?p={{N}}' ELSE '' END AS template,
  CASE page_id % 5 WHEN 2 THEN CASE WHEN gallery THEN '' ELSE 'a[rel="next"]' END WHEN 3 THEN '[aria-label="All pagination"] a' ELSE '' END AS selector FROM g
"""


def card_groups(spark, folder):
    """Brands as listing pages: their parts are cards under a section per type, two in three with a price."""
    kind = F.lower(F.split_part("p_type", F.lit(" "), F.lit(1)))
    price = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("<b>$ "), F.col("p_retailprice").cast("decimal(18,2)").cast("string"), F.lit("</b>"))).otherwise("")
    card = F.concat(F.lit('<li><a href="/'), kind, F.lit("/product/item-"), F.col("p_partkey").cast("string"), F.lit('"><img src="i"></a>'), price, F.lit("</li>"))
    listed = table(spark, folder, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", card.alias("card")))).alias("cards"))
    pages = listed.select("p_brand", F.lit("https://shop.example.com/all").alias("url"), F.concat(F.lit("<html><body><ul>"), F.array_join(F.transform("cards", lambda c: c["card"]), ""), F.lit("</ul></body></html>")).alias("html"))
    nodes = H.nodes(pages, "p_brand", "html").withColumn("url", F.lit("https://shop.example.com/all"))
    return C.card_groups(C.card_links(nodes, "p_brand", "url"), "p_brand").select("p_brand", "how", "shape", "members", "carded")


CARD_GROUPS = """
WITH t AS (SELECT p_brand, lower(split_part(p_type, ' ', 1)) AS kind, count(*) AS members, count(*) FILTER (p_partkey % 3 <> 0) AS carded, min(p_partkey) AS first FROM part GROUP BY 1, 2),
m AS (SELECT p_brand, count(*) FILTER (carded >= 2) >= 3 AS merges FROM t GROUP BY 1),
g AS (SELECT t.p_brand, CASE WHEN merges AND carded > 0 THEN '*' ELSE kind END AS kind, sum(members) AS members, sum(carded) AS carded, min(first) AS first FROM t JOIN m ON t.p_brand = m.p_brand GROUP BY 1, 2),
p AS (SELECT p_brand, 'priced' AS how, kind, members, carded, 1 AS tier, first FROM g WHERE carded > 0)
SELECT p_brand, how, 'shop.example.com/' || kind || '/product/*' AS shape, CAST(members AS BIGINT) AS members, CAST(carded AS BIGINT) AS carded FROM p QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY carded DESC, members DESC, first) = 1
UNION ALL SELECT p_brand, 'imaged', 'shop.example.com/' || min(kind) || '/product/*', CAST(sum(members) AS BIGINT), CAST(sum(members) AS BIGINT) FROM t GROUP BY 1 HAVING sum(carded) = 0 AND sum(members) >= 6 AND count(*) = 1
"""


def _walk(spark, folder):
    linked = _links(spark, folder).select(U.root_domain(U.host(F.col("_page"))).alias("run"), F.lit(0).alias("input"), F.col("page_id").alias("page"), "pos", "url")
    pages = table(spark, folder, "pages").select(U.root_domain(U.host(F.col("url"))).alias("run"), F.lit(0).alias("input"), F.col("page_id").alias("page"), F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("url"))
    return C.walk(linked.unionByName(pages), 20)


def walk_items(spark, folder):
    """What a walk over a domain's pages plans: 20 addresses at most, until a page brings nothing new."""
    return _walk(spark, folder)[0].select("run", "url", "page", "place")


def walk_reports(spark, folder):
    return _walk(spark, folder)[1].select("run", "items", "page_one", "gained", F.coalesce("stop", F.lit("")).alias("stop"), "thin")


_WALK = _LINKS + """
, w AS (SELECT array_to_string(string_split(r.host, '.')[-2:], '.') AS run, r.page_id AS page, pos, r.url FROM r JOIN u USING (page_id)),
f AS (SELECT *, url IS NOT NULL AND row_number() OVER (PARTITION BY run, url ORDER BY page, pos) = 1 AS fresh FROM w),
n AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY page, pos) AS place FROM f),
p AS (SELECT array_to_string(labels[-2:], '.') AS run, page_id AS page FROM s),
c AS (SELECT p.run, p.page, count(*) FILTER (fresh) AS new, max(place) AS sum, coalesce(bool_or(url IS NOT NULL), false) AS told FROM p LEFT JOIN n ON p.run = n.run AND p.page = n.page GROUP BY 1, 2),
j AS (SELECT *, CASE WHEN new > 0 AND sum >= 20 THEN 'budget' WHEN new = 0 AND told THEN 'all-duplicates' WHEN new = 0 THEN 'empty-page' END AS stop FROM c),
e AS (SELECT run, min(page) AS one, min(page) FILTER (stop IS NOT NULL) AS ended, arg_min(stop, page) FILTER (stop IS NOT NULL) AS stop FROM j GROUP BY 1),
i AS (SELECT n.run, n.url, n.page, CAST(n.place AS BIGINT) AS place, n.page = e.one AS on_one FROM n JOIN e ON n.run = e.run WHERE fresh AND place <= 20 AND (ended IS NULL OR n.page <= ended))
"""
WALK_ITEMS = _WALK + "SELECT run, url, page, place FROM i"
WALK_REPORTS = _WALK + """
, k AS (SELECT e.run, count(i.url) AS items, count(i.url) FILTER (on_one) AS page_one, any_value(e.stop) AS stop FROM e LEFT JOIN i ON e.run = i.run GROUP BY 1)
SELECT run, items, page_one, items - page_one AS gained, coalesce(stop, '') AS stop, coalesce(stop, '') <> 'budget' AND page_one > 0 AND items - page_one < 0.25 * page_one AS thin FROM k
"""


def _planned_inputs(spark, folder):
    """A supplier's lines as captured lists of products: line numbers are the inputs of its run, years their pages, kinds
    of parts the addresses. Later inputs meet what earlier ones hold, and stop at pages without anything new."""
    kinds = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", F.lit("https://shop.example.com"), "p_brand", "p_type").alias("url"))
    # parts grow with the lines, and an address is much longer than what is stored of it: no broadcast, which the driver would hold
    lines = table(spark, folder, "lineitem").join(kinds.hint("merge"), "l_partkey")
    rows = lines.select(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("input"), F.year("l_shipdate").alias("page"), F.col("l_orderkey").alias("pos"), "url")
    # most runs have inputs that meet: folding them in order at once moves a row twice, each reading together moves it again
    return C.walk(rows, C.PLAN_ITEMS, most_pages=C.PLAN_PAGES, looks=0)


def planned_addresses(spark, folder):
    """Which input of a run holds each address, by the default budget: 50 addresses of three pages an input."""
    return _planned_inputs(spark, folder)[0].select("run", "input", "url", "page", "place")


def planned_reports(spark, folder):
    """What each input planned, why it stopped, and whether its way to the next page may be kept."""
    return _planned_inputs(spark, folder)[1].select("run", "input", "items", "page_one", "gained", F.coalesce("stop", F.lit("")).alias("stop"), "thin", "certifies")


# inputs one after another: each step sees what the ones before it hold
_PLANNED = """
WITH RECURSIVE w0 AS (SELECT l_suppkey AS run, l_linenumber AS input, CAST(year(l_shipdate) AS INT) AS page, l_orderkey AS pos, 'https://shop.example.com/' || p_brand || '/' || p_type AS url FROM lineitem JOIN part ON l_partkey = p_partkey),
w AS (SELECT *, row_number() OVER (PARTITION BY run, input, url ORDER BY page, pos) = 1 AS own FROM (SELECT *, dense_rank() OVER (PARTITION BY run, input ORDER BY page) AS nth FROM w0) WHERE nth <= 3),
b AS (SELECT run, input, page, pos, url, own FROM w UNION ALL SELECT run, i, 0, -2, NULL, false FROM (SELECT DISTINCT run FROM w) CROSS JOIN range(8) t(i) WHERE (run, i) NOT IN (SELECT (run, input) FROM w)),
st AS (SELECT DISTINCT run, CAST(-1 AS BIGINT) AS input, CAST([] AS VARCHAR[]) AS taken FROM w
  UNION ALL SELECT run, input, list_concat(any_value(taken), coalesce(list(url) FILTER (fresh AND place <= 50 AND NOT hidden), [])) FROM
    (SELECT *, coalesce(bool_or(ends) OVER (PARTITION BY run ORDER BY page RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS hidden FROM
      (SELECT *, max(place) OVER (PARTITION BY run, page) >= 50 OR count(*) FILTER (fresh) OVER (PARTITION BY run, page) = 0 AS ends FROM
        (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY page, pos, url ROWS UNBOUNDED PRECEDING) AS place FROM
          (SELECT b.*, st.taken, own AND NOT list_contains(st.taken, b.url) AS fresh FROM st JOIN b ON st.run = b.run AND CAST(b.input AS BIGINT) = st.input + 1)))) GROUP BY run, input),
f AS (SELECT w.*, own AND NOT list_contains(st.taken, w.url) AS fresh FROM w JOIN st ON w.run = st.run AND w.input = st.input + 1),
n AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY run, input ORDER BY page, pos, url ROWS UNBOUNDED PRECEDING) AS place FROM f),
c AS (SELECT run, input, page, count(*) FILTER (fresh) AS new, max(place) AS sum, bool_or(url IS NOT NULL) AS told FROM n GROUP BY 1, 2, 3),
j AS (SELECT *, CASE WHEN new > 0 AND sum >= 50 THEN 'budget' WHEN new = 0 AND told THEN 'all-duplicates' WHEN new = 0 THEN 'empty-page' END AS stop FROM c),
e AS (SELECT run, input, min(page) AS one, min(page) FILTER (stop IS NOT NULL) AS ended, arg_min(stop, page) FILTER (stop IS NOT NULL) AS stop FROM j GROUP BY 1, 2),
i AS (SELECT n.run, n.input, n.url, n.page, CAST(n.place AS BIGINT) AS place, n.page = e.one AS on_one FROM n JOIN e ON n.run = e.run AND n.input = e.input WHERE fresh AND place <= 50 AND (ended IS NULL OR n.page <= ended)),
k AS (SELECT e.run, e.input, count(i.url) AS items, count(i.url) FILTER (on_one) AS page_one, any_value(e.stop) AS stop FROM e LEFT JOIN i ON e.run = i.run AND e.input = i.input GROUP BY 1, 2)
"""
PLANNED_ADDRESSES = _PLANNED + "SELECT run, input, url, page, place FROM i"
PLANNED_REPORTS = _PLANNED + """
SELECT *, gained > 0 AND NOT thin AS certifies FROM (SELECT run, input, items, page_one, items - page_one AS gained, coalesce(stop, '') AS stop, coalesce(stop, '') <> 'budget' AND page_one > 0 AND items - page_one < 0.25 * page_one AS thin FROM k)
"""


def direct_plans(spark, folder):
    """Events as a user's inputs, an address by the product's number: budgets of five kinds, addresses once a run."""
    k = F.get_json_object("props", "$.k")
    budgets = F.element_at(F.array(*[F.lit(x) for x in ('{"max_items":3}', '{"max_items":"3"}', '{"mode":"all"}', '{"max_items":2.5}', "none")]), (F.col("user_id") % 5 + 1).cast("int"))
    inputs = table(spark, folder, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("input"), F.concat(F.lit("https://shop.example.com/p/"), k).alias("url"), C.budget(budgets)["items"].alias("cap"))
    return C.plan_direct(inputs).select("run", "input", "status", "items")


DIRECT_PLANS = """
WITH e AS (SELECT user_id AS run, event_id AS input, json_extract_string(props, '$.k') AS k, [3, 50, 5000, 50, 50][1 + user_id % 5] AS cap FROM events),
f AS (SELECT run, k, min(input) AS owner, any_value(cap) AS cap FROM e WHERE k IS NOT NULL GROUP BY 1, 2), h AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY run ORDER BY owner) <= cap)
SELECT e.run, e.input, CASE WHEN e.k IS NULL THEN 'error' WHEN owner IS NULL THEN 'skipped_budget' ELSE 'planned' END AS status, CAST(coalesce(owner = e.input, false) AS INT) AS items FROM e LEFT JOIN h ON e.run = h.run AND e.k = h.k
"""


def listing_api(spark, folder):
    """Which kind of event holds most of what a user bought: kinds are responses, their numbers are identifiers."""
    k = F.get_json_object("props", "$.k")
    events = table(spark, folder, "events").select("user_id", "event_type", k.alias("identifier")).where("identifier IS NOT NULL")
    arrays = events.where("event_type <> 'purchase'").select("user_id", F.col("event_type").alias("response"), F.lit("items").alias("array_path"), "identifier")
    found = P.listing_api(arrays, events.where("event_type = 'purchase'").select("user_id", "identifier"), ["user_id"], least=2, share=0.1)
    return found.select("user_id", F.col("matched"), F.round("covered", 6).alias("covered"))


LISTING_API = """
WITH e AS (SELECT DISTINCT user_id, event_type AS response, json_extract_string(props, '$.k') AS id FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL), w AS (SELECT user_id, id FROM e WHERE response = 'purchase'),
t AS (SELECT user_id, count(*) AS total FROM w GROUP BY 1), l AS (SELECT user_id, response, count(*) AS length FROM e WHERE response <> 'purchase' GROUP BY 1, 2),
m AS (SELECT e.user_id, e.response, count(*) AS matched FROM e JOIN w ON e.user_id = w.user_id AND e.id = w.id WHERE response <> 'purchase' GROUP BY 1, 2)
SELECT m.user_id, matched, round(matched / total, 6) AS covered FROM m JOIN t ON m.user_id = t.user_id JOIN l ON m.user_id = l.user_id AND m.response = l.response WHERE matched >= 2 AND matched / total >= 0.1
QUALIFY row_number() OVER (PARTITION BY m.user_id ORDER BY matched / total DESC, length DESC) = 1
"""


def shown_values(spark, folder):
    """Whether names and balances stand in a page's text; dates are not checked, values of elements always are."""
    n = F.col("c_custkey")
    text = F.concat(F.lit("<Shop> "), F.when(n % 2 == 0, F.upper("c_name")).otherwise("c_mktsegment"), F.lit(" pays "), F.format_number(F.abs("c_acctbal"), 2), F.lit(" by "), "c_mktsegment")
    source = F.when(n % 5 == 0, "xpath").otherwise("api")
    told = lambda kind, value: F.coalesce(N.shown_on_page(kind, source, value, text, words=["pays"]).cast("string"), F.lit("unchecked"))
    balance = F.when(n % 3 == 0, F.lit("123456789.125")).otherwise(F.abs("c_acctbal").cast("decimal(18,2)").cast("string"))
    return table(spark, folder, "customer").select("c_custkey", told("text", F.col("c_name")).alias("name"), told("number", balance).alias("balance"), told("date", F.lit("2024-01-01")).alias("day"))


SHOWN_VALUES = """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 2 = 0 OR contains(lower(c_mktsegment), lower(c_name)) THEN 'true' ELSE 'false' END AS name,
  CASE WHEN c_custkey % 5 = 0 OR c_custkey % 3 <> 0 THEN 'true' ELSE 'false' END AS balance, 'unchecked' AS day FROM customer
"""


def expected_errors(spark, folder):
    """Messages for expected values of three types: empty, unusable, good."""
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.lit(" ")).when(F.col("o_orderkey") % 4 == 1, F.col("o_orderpriority")).when(F.col("o_orderkey") % 4 == 2, F.col("o_totalprice").cast("decimal(18,2)").cast("string")).otherwise("yes")
    told = lambda kind: F.coalesce(S.expected_error(kind, F.col("raw")), F.lit("")).alias(kind)
    return table(spark, folder, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", told("money"), told("boolean"), told("text"))


EXPECTED_ERRORS = """
WITH r AS (SELECT o_orderkey, o_orderkey % 4 AS k, o_orderpriority AS p FROM orders)
SELECT o_orderkey, CASE WHEN k = 0 THEN 'Expected value is required' WHEN k = 2 OR (k = 1 AND regexp_matches(p, '[0-9]')) THEN '' ELSE 'Not a money amount' END AS money,
  CASE WHEN k = 0 THEN 'Expected value is required' WHEN k = 3 THEN '' ELSE 'Not yes/no (or in stock/out of stock)' END AS boolean, CASE WHEN k = 0 THEN 'Expected value is required' ELSE '' END AS text FROM r
"""


def address_forms(spark, folder):
    """Patterns of identifiers and keys of images of every page's address."""
    u = F.concat(U.without_fragment(F.col("url")), F.lit("#x"))
    longer = F.regexp_replace(u, r"^([^?#]*)", "$1/0a1b2c3d-44/small.jpg")
    return table(spark, folder, "pages").select("page_id", U.id_pattern(longer).alias("pattern"), U.image_key(longer).alias("image"))


ADDRESS_FORMS = _PARTS + r"""
SELECT page_id, scheme || '://' || host || regexp_replace(path || '/0a1b2c3d-44/small.jpg', '/[0-9a-fA-F-]{8,}', '/{id}', 'g') AS pattern, host || path || '/0a1b2c3d-44/small.jpg' AS image FROM s
"""


def label_forms(spark, folder):
    """Option labels in one form, and whether a shown label holds all words of the address's."""
    label = F.concat(F.lit('"'), F.upper("p_type"), F.lit("\" – 0"), F.col("p_size").cast("string"), F.lit(" × 04 / 7′"))
    other = F.concat("p_type", F.lit(" deluxe"))
    return table(spark, folder, "part").select("p_partkey", T.label_form(label).alias("label"), T.labels_agree(F.col("p_type"), other).alias("agrees"), T.labels_agree(F.col("p_name"), other).alias("named"))


LABEL_FORMS = """
SELECT p_partkey, lower(p_type) || ' ' || p_size || 'x4 7' AS label, true AS agrees,
  len(list_filter(string_split_regex(trim(lower(p_name)), '[^a-z0-9]+'), lambda x: NOT list_contains(string_split_regex(lower(p_type) || ' deluxe', '[^a-z0-9]+'), x))) = 0 AS named FROM part
"""


def canonical_paths(spark, folder):
    """Two spellings of one path come out alike."""
    path = F.concat(F.lit("//div[ @id = '"), "p_brand", F.lit("' ]/span[ "), F.col("p_size").cast("string"), F.lit(" ]"))
    return table(spark, folder, "part").select("p_partkey", H.canonical_xpath(path).alias("path"))


CANONICAL_PATHS = """SELECT p_partkey, '//div[@id="' || p_brand || '"]/span[' || p_size || ']' AS path FROM part"""


def _bodies(spark, folder):
    """Orders as JSON with their lines as an array of objects."""
    line = F.struct(F.col("l_partkey").alias("sku"), F.col("l_returnflag").alias("color"), F.struct(F.col("l_linenumber").alias("price")).alias("offers"))
    lines = spread(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line")), "l_orderkey")
    lines = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "line"))).alias("lines"))
    document = F.struct(F.col("l_orderkey").alias("id"), F.transform("lines", lambda x: x["line"]).alias("rows"), F.array(F.lit("a"), F.lit("b")).alias("tags"))
    return lines.select("l_orderkey", F.size("lines").alias("lines"), F.to_json(document).alias("body"))


def flattened_responses(spark, folder):
    """Leaves of recorded responses: three items of a list, lists of plain values whole, a later body of an address goes."""
    bodies = _bodies(spark, folder)
    seen = F.struct(F.lit("https://a.example.com/api").alias("url"), F.col("body"), F.lit(0).alias("seq"))
    again = F.struct(F.lit("https://a.example.com/api").alias("url"), F.lit('{"id":-1}').alias("body"), F.lit(1).alias("seq"))
    setup = F.struct(F.lit("https://a.example.com/config").alias("url"), F.lit('{"setup":1}').alias("body"), F.lit(2).alias("seq"))
    later = F.struct(F.lit("https://a.example.com/more").alias("url"), F.lit('{"id":7,"more":{"deep":null,"x":1}}').alias("body"), F.lit(3).alias("seq"))
    requests = bodies.select("l_orderkey", F.explode(F.array(seen, again, setup, later)).alias("r")).select("l_orderkey", "r.*")
    return J.flatten_responses(requests, ["l_orderkey"], parts=parts_of(table(spark, folder, "lineitem"))).select("l_orderkey", "path", "value")


FLATTENED_RESPONSES = """
WITH l AS (SELECT l_orderkey, l_partkey, l_returnflag, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) - 1 AS n FROM lineitem)
SELECT DISTINCT l_orderkey, 'id' AS path, '7' AS value FROM l UNION ALL SELECT DISTINCT l_orderkey, 'tags', '["a","b"]' FROM l UNION ALL SELECT DISTINCT l_orderkey, 'more.x', '1' FROM l
UNION ALL SELECT l_orderkey, 'rows[' || n || '].sku', CAST(l_partkey AS VARCHAR) FROM l WHERE n < 3 UNION ALL SELECT l_orderkey, 'rows[' || n || '].color', l_returnflag FROM l WHERE n < 3
UNION ALL SELECT l_orderkey, 'rows[' || n || '].offers.price', CAST(l_linenumber AS VARCHAR) FROM l WHERE n < 3
"""


def array_paths(spark, folder):
    """Arrays of objects among the leaves of a response with as many items as an order has lines."""
    leaves = J.leaf_table(_bodies(spark, folder), ["l_orderkey"], "body", J.CANDIDATES)
    return J.array_paths(leaves, ["l_orderkey"])


ARRAY_PATHS = "SELECT l_orderkey, 'rows' AS array_path, count(*) AS items FROM lineitem GROUP BY 1"


def entity_subtrees(spark, folder):
    """Orders as documents of differing depth: their richest object, with a ``selected`` one close by that one."""
    n = F.col("o_orderkey")
    own = F.concat(
        F.lit('{"'), F.lower("o_orderstatus"), F.lit('Name":"x","prices":{"currency":"c","amount":'), n.cast("string"), F.lit("}"),
        F.when(F.col("o_custkey") % 2 == 0, ',"brand":{}').otherwise(""), F.when(F.col("o_custkey") % 3 == 0, ',"colors":null,"sizes":[]').otherwise(""), F.lit("}"),
    )
    key = F.when(n % 5 == 0, '"product"').when(n % 5 == 1, '"selected":[{"x"').otherwise('"selectedItem"')
    close = F.when(n % 5 == 1, "}]").otherwise("")
    document = F.concat(F.lit("{"), key, F.lit(":"), own, close, F.lit(',"other":{"title":"t","image":"i","sku":"s"}}'))
    depth = (n % 8 * 2).cast("int")
    body = F.concat(F.repeat(F.lit('{"page":['), depth), document, F.repeat(F.lit("]}"), depth))
    leaves = J.leaf_table(table(spark, folder, "orders").select("o_orderkey", body.alias("body")), ["o_orderkey"], "body", J.ENTITIES)
    return DOC.entity_subtree(leaves, ["o_orderkey"])


_TOKENS = ", ".join(f"'{t}'" for t in DOC.ENTITY_TOKENS)
ENTITY_SUBTREES = rf"""
WITH d AS (SELECT o_orderkey, repeat('{{"page":[', CAST(o_orderkey % 8 * 2 AS INT)) || '{{' || CASE o_orderkey % 5 WHEN 0 THEN '"product"' WHEN 1 THEN '"selected":[{{"x"' ELSE '"selectedItem"' END || ':{{"' || lower(o_orderstatus) || 'Name":"x","prices":{{"currency":"c","amount":' || o_orderkey || '}}'
  || CASE WHEN o_custkey % 2 = 0 THEN ',"brand":{{}}' ELSE '' END || CASE WHEN o_custkey % 3 = 0 THEN ',"colors":null,"sizes":[]' ELSE '' END || '}}' || CASE WHEN o_orderkey % 5 = 1 THEN '}}]' ELSE '' END || ',"other":{{"title":"t","image":"i","sku":"s"}}}}' || repeat(']}}', CAST(o_orderkey % 8 * 2 AS INT)) AS body FROM orders),
t AS (SELECT d.o_orderkey, j.id, j.parent, j.key, j.fullkey, j.type, j.path FROM d, json_tree(d.body) j),
k AS (SELECT c.o_orderkey, c.parent AS id, c.key, x.token FROM t c JOIN (SELECT unnest([{_TOKENS}]) AS token) x ON contains(lower(c.key), x.token)),
o AS (SELECT p.o_orderkey, p.id, substr(p.fullkey, 3) AS path, coalesce(contains(lower(p.key), 'selected') AND NOT ends_with(p.fullkey, ']'), false) AS chosen, count(DISTINCT token) AS score FROM t p JOIN k ON p.o_orderkey = k.o_orderkey AND p.id = k.id
  WHERE p.type = 'OBJECT' AND len(regexp_extract_all(p.fullkey, '\.|\[')) <= 12 GROUP BY ALL HAVING count(DISTINCT token) >= 2),
m AS (SELECT o_orderkey, max(score) AS most FROM o GROUP BY 1), c AS (SELECT o.*, chosen AND score >= most - 1 AS wins FROM o JOIN m USING (o_orderkey))
SELECT o_orderkey, path, score FROM c QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY wins DESC, score DESC, id) = 1
"""


def page_shapes(spark, folder):
    """What kind of page the linked data of each tells: types, place of the offers, a rating, the address's pattern."""
    n = F.col("page_id")
    kind = F.when(n % 3 == 0, '{"@type":"Product","offers":{"price":"1"},"aggregateRating":{"ratingValue":"4"}}').when(n % 3 == 1, '{"@type":"ProductGroup","hasVariant":[{"@type":"Product","offers":{"price":"2"}}],"aggregateRating":{"ratingValue":"0"}}')
    pages = table(spark, folder, "pages").select("page_id", "url", kind.alias("body"))
    leaves = J.leaf_table(pages, ["page_id"], "body", J.CANDIDATES)
    return DOC.page_shapes(pages, leaves, ["page_id"], "url").select("page_id", "pattern", F.array_join("types", ",").alias("types"), "offers", "rating")


PAGE_SHAPES = _PARTS + r"""
SELECT page_id, regexp_replace(path, '\d+', 'n', 'g') || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(list_sort(list_distinct(list_transform(pairs, lambda p: split_part(p, '=', 1)))), '&') ELSE '' END AS pattern,
  ['Product', 'Product,ProductGroup', ''][1 + page_id % 3] AS types, ['top-level', 'in-variants', 'none'][1 + page_id % 3] AS offers, page_id % 3 = 0 AS rating FROM s
"""


def page_hints(spark, folder):
    """Listings that look like details, and details that call themselves lists."""
    linked = table(spark, folder, "pages").select("page_id", F.col("page_id").alias("n"), F.size(H.links(F.col("html"))).alias("rows"))
    kind = F.element_at(F.array(F.lit("ItemList"), F.lit("Product"), F.lit("CollectionPage")), (F.col("n") % 3 + 1).cast("int"))
    return linked.select("page_id", P.listing_hint(F.col("rows") % 5, F.col("n") % 2 == 0).alias("listing"), P.detail_hint(kind).alias("detail"))


PAGE_HINTS = "SELECT page_id, len(regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a>')) % 5 <= 2 AND page_id % 2 <> 0 AS listing, page_id % 3 <> 1 AS detail FROM pages"


def fitting_shapes(spark, folder):
    """Pages that fit a group's shape in which any one segment may vary: met by host and number of segments."""
    shape = U.url_shape(F.col("url"))
    own = table(spark, folder, "pages").select("page_id", shape.alias("own"), F.split_part(shape, F.lit("/"), F.lit(1)).alias("host"), F.size(F.split(shape, "/")).alias("depth"))
    groups = own.select("host", "depth", F.regexp_replace("own", r"/[^/]*$", "/*").alias("shape")).distinct()
    return own.join(groups, ["host", "depth"]).where(U.fits_shape(F.col("shape"), F.col("own"))).select("page_id", "shape")


FITTING_SHAPES = _PARTS + rf"""
, o AS (SELECT page_id, bare AS host, string_split(bare || {_SHAPED}, '/') AS parts FROM s), g AS (SELECT DISTINCT host, parts[:len(parts) - 1] || ['*'] AS shape FROM o)
SELECT page_id, array_to_string(shape, '/') AS shape FROM o JOIN g ON o.host = g.host AND len(parts) = len(shape)
WHERE len(list_filter(range(1, len(parts) + 1), lambda i: parts[i] <> shape[i] AND NOT (i > 1 AND shape[i] = '*'))) = 0
"""


def page_variants(spark, folder):
    """The one line of an order that is the page's variant: by part, else by status without a contradiction."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("order"), "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("order"), "o_orderstatus")
    flag = F.when(F.col("o_orderstatus") == "F", "R").otherwise("N")
    text = lambda c: F.col(c).cast("string")
    none = F.array().cast("array<string>")
    matches = M.entry_matches(F.array(text("l_partkey")), F.create_map(F.lit("flag"), F.col("l_returnflag")), F.array(text("l_linestatus")), none, F.create_map(F.lit("flag"), F.col("flag")), none)
    found = M.page_entry(lines.join(orders, "order").withColumn("flag", flag), ["order"], matches)
    return found.select(F.col("order").alias("o_orderkey"), "l_linenumber")


PAGE_VARIANTS = """
SELECT o_orderkey, min(l_linenumber) AS l_linenumber FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = CASE WHEN o_orderstatus = 'F' THEN 'R' ELSE 'N' END GROUP BY 1 HAVING count(*) = 1
"""


def path_conflicts(spark, folder):
    """Customers as fields, their orders as paths: totals that differ by a twentieth or more; some are protected."""
    orders = table(spark, folder, "orders").select("o_custkey", F.floor(F.col("o_totalprice") / 1000).cast("string").alias("last_value"), (F.col("o_orderkey") % 50 == 0).alias("protected"), F.lit("u").alias("last_url"))
    return reports.path_conflicts(orders, ["o_custkey"])


PATH_CONFLICTS = """
WITH o AS (SELECT o_custkey, o_orderkey, floor(o_totalprice / 1000) AS v FROM orders), p AS (SELECT DISTINCT a.o_custkey FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.v > b.v WHERE (a.v - b.v) / a.v >= 0.05)
SELECT o_custkey, count(*) AS paths FROM o SEMI JOIN p USING (o_custkey) GROUP BY 1 HAVING count(*) >= 2 AND NOT bool_or(o_orderkey % 50 = 0)
"""


def mechanical_values(spark, folder):
    """Fields read from leaves by name: whole path, alias, path end; responses before linked data."""
    leaves = table(spark, folder, "part").select("p_partkey", F.explode(F.array(
        F.struct(F.lit("json-ld").alias("pool"), F.lit("name").alias("path"), F.lit(0).alias("pos"), F.col("p_name").alias("value")),
        F.struct(F.lit("api").alias("pool"), F.lit("item.title").alias("path"), F.lit(1).alias("pos"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("value")),
        F.struct(F.lit("json-ld").alias("pool"), F.lit("offers.price").alias("path"), F.lit(2).alias("pos"), F.col("p_size").cast("string").alias("value")),
        F.struct(F.lit("api").alias("pool"), F.lit("data.list.price").alias("path"), F.lit(3).alias("pos"), F.when(F.col("p_partkey") % 3 == 0, F.lit("9")).alias("value")),
    )).alias("l")).select("p_partkey", "l.*")
    found = E.mechanical(leaves, ["p_partkey"], E.alias_table(spark, ["title", "price"]))
    return found.select("p_partkey", "field", "value", "path", "source")


MECHANICAL_VALUES = """
SELECT p_partkey, 'title' AS field, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END AS value, CASE WHEN p_partkey % 2 = 0 THEN 'item.title' ELSE 'name' END AS path, CASE WHEN p_partkey % 2 = 0 THEN 'api' ELSE 'json-ld' END AS source FROM part
UNION ALL SELECT p_partkey, 'price', CASE WHEN p_partkey % 3 = 0 THEN '9' ELSE CAST(p_size AS VARCHAR) END, CASE WHEN p_partkey % 3 = 0 THEN 'data.list.price' ELSE 'offers.price' END, CASE WHEN p_partkey % 3 = 0 THEN 'api' ELSE 'json-ld' END FROM part
"""


def structured_pages(spark, folder):
    """Data inside pages: linked data (a broken block goes), state of the application, meta tags (the last of a name)."""
    name = F.regexp_replace(H.title(F.col("html")), r'["\\]', "")
    data = F.concat(F.lit('<script type="application/ld+json">{"name":"'), name, F.lit('"}</script><script type="application/ld+json">{broken</script><script id="__NEXT_DATA__">{"id":'), F.col("page_id").cast("string"),
                    F.lit('}</script><meta property="og:title" content="first"><meta property="og:title" content="'), F.md5("url"), F.lit('">'))
    s = H.structured_data(F.concat("html", data))
    return table(spark, folder, "pages").select("page_id", s.alias("s")).select("page_id", F.size("s.ld_json").cast("long").alias("blocks"), F.get_json_object(F.try_element_at("s.ld_json", F.lit(1)), "$.name").alias("name"),
                                                                        F.get_json_object("s.next_data", "$.id").alias("id"), F.try_element_at("s.meta", F.lit("og:title")).alias("title"))


STRUCTURED_PAGES = r"""
SELECT page_id, CAST(1 AS BIGINT) AS blocks, regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '["\\]', '', 'g') AS name, CAST(page_id AS VARCHAR) AS id, md5(url) AS title FROM pages
"""


def json_requests(spark, folder):
    """Recorded responses of captures: those that are JSON, in capture order."""
    call = lambda url, ok, body: F.struct(url.alias("url"), F.lit(ok).alias("is_json"), body.alias("body"))
    calls = F.array(call(F.lit("/a"), True, F.col("props")), call(F.lit("/b"), True, F.lit("<html>")), call(F.lit("/c"), False, F.col("props")), call(F.lit("/d"), True, F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit("]"))))
    captured = table(spark, folder, "events").select("event_id", calls.alias("requests"))
    return tables.json_requests(captured, ["event_id"]).select("event_id", F.col("seq").cast("long").alias("seq"), "url", "body")


JSON_REQUESTS = """
SELECT event_id, CAST(0 AS BIGINT) AS seq, '/a' AS url, props AS body FROM events WHERE props IS NOT NULL UNION ALL SELECT event_id, 3, '/d', '[' || user_id || ']' FROM events WHERE user_id IS NOT NULL
"""


def value_search(spark, folder):
    """Where the label of each page's second link stands among its elements: three places at most."""
    pages = table(spark, folder, "pages").select("page_id", "html")
    wanted = pages.select("page_id", F.lit("label").alias("field"), F.upper(F.try_element_at(H.links(F.col("html")), F.lit(2))["text"]).alias("value")).where("value <> ''")
    found = H.search_value(H.nodes(pages, "page_id", "html"), "page_id", wanted)
    return found.where(F.contains("xpath", F.lit("/nav[1]/"))).groupBy("page_id").agg(F.min("xpath").alias("xpath"))


VALUE_SEARCH = r"""
WITH l AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav><ul>(.*?)</ul>', 1), '<a href="[^"]*">(.*?)</a>', 1) AS l FROM pages)
SELECT page_id, '/html[1]/body[1]/nav[1]/ul[1]/li[' || list_position(list_transform(l, lambda x: lower(x)), lower(l[2])) || ']/a[1]' AS xpath FROM l WHERE len(l) >= 2
"""


def event_windows(spark, folder):
    """Events by kind and hour: the batch form of the stream's tumbling windows."""
    found = windows.windowed_counts(table(spark, folder, "events"), "ts", "event_type")
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "events", F.round("total", 2).alias("total"))


EVENT_WINDOWS = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"


def event_sessions(spark, folder):
    """Sessions of users with no gap over half an hour: the batch form of the stream's sessions."""
    found = windows.sessions(table(spark, folder, "events"), "ts", "user_id")
    return found.select(F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "events")


EVENT_SESSIONS = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS events FROM s GROUP BY user_id, n
"""


def string_paths(spark, folder):
    """Paths to texts in an order as an object: its own, and those of objects right in it."""
    inner = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"), F.struct(F.lit("x").alias("deep")).alias("more"))
    body = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("priority"), inner.alias("inner"), F.array(F.lit("a")).alias("tags")))
    return table(spark, folder, "orders").select("o_orderkey", F.array_join(DOC.string_paths(body), ",").alias("paths"))


STRING_PATHS = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'inner.status,priority' ELSE 'inner.status' END AS paths FROM orders"


def collected_identifiers(spark, folder):
    """Identifiers of the addresses of an order's lines; a number is no address, a short segment no identifier."""
    n = F.col("l_partkey")
    link = F.when(n % 3 == 0, F.concat(F.lit("/p/item-"), n.cast("string"), F.lit("?v=1"))).when(n % 3 == 1, F.concat(F.lit("https://x.example/p/"), n.cast("string"), F.lit("-long#a"))).otherwise(F.lit("/p/abc"))
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", link.alias("href")))).alias("lines"))
    body = F.to_json(F.struct(F.struct(F.transform("lines", lambda x: F.struct(F.struct(x["href"].alias("href")).alias("link"))).alias("rows")).alias("data")))
    found = DOC.collected_identifiers(body, F.lit("data.rows"), F.lit("link.href"), most=5)
    return lines.select("l_orderkey", F.array_join(found, ",").alias("ids"))


COLLECTED_IDENTIFIERS = """
WITH l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem),
i AS (SELECT l_orderkey, n, CASE l_partkey % 3 WHEN 0 THEN 'item-' || l_partkey WHEN 1 THEN l_partkey || '-long' END AS id FROM l WHERE n <= 5)
SELECT l_orderkey, coalesce(string_agg(id, ',' ORDER BY n), '') AS ids FROM i GROUP BY 1
"""


def concept_candidates(spark, folder):
    """Leaves that may be a price: by the end of their path, plain or in cents; words are none."""
    n = F.col("p_partkey")
    leaf = lambda path, value, seq: F.struct(F.lit("api").alias("source"), F.lit(seq).alias("seq"), F.lit(seq).alias("pos"), F.lit(path).alias("path"), value.cast("string").alias("value"))
    listed = F.array(leaf("offers.price", F.col("p_size"), 0), leaf("item.price_cents", n * 100, 1), leaf("price", F.when(n % 2 == 0, F.lit("soon")).otherwise(F.lit("7.5")), 2), leaf("name", n, 3), leaf("offers.price", n, 4))
    leaves = table(spark, folder, "part").select("p_partkey", F.explode(listed).alias("l")).select("p_partkey", "l.*")
    return DOC.concept_candidates(leaves, ["p_partkey"], "money", "price").select("p_partkey", "path", "value", "transform")


CONCEPT_CANDIDATES = """
SELECT p_partkey, 'offers.price' AS path, CAST(p_size AS VARCHAR) AS value, 'identity' AS transform FROM part UNION ALL SELECT p_partkey, 'item.price_cents', CAST(p_partkey * 100 AS VARCHAR), 'cents_to_units' FROM part
UNION ALL SELECT p_partkey, 'price', '7.5', 'identity' FROM part WHERE p_partkey % 2 <> 0
"""


def wrong_variants(spark, folder):
    """Pages that show another variant than the one their address names, by size, colour or identifier."""
    n = F.col("p_partkey")
    size = F.col("p_size").cast("string")
    url = F.concat(F.lit("https://x.example/p?size="), size, F.lit("&utm_source=a"), F.when(n % 4 == 0, F.concat(F.lit("&variant="), (n + 1000000).cast("string"))).otherwise(""))
    ids = F.array((F.when(n % 8 == 0, n).otherwise(n + 1) + 1000000).cast("string"))
    pairs = F.when(n % 3 == 0, F.create_map(F.lit("size"), F.concat(size, F.lit(" cm")))).when(n % 3 == 1, F.create_map(F.lit("size"), F.lit("none"))).otherwise(F.create_map(F.lit("colour"), F.lit("red")))
    return table(spark, folder, "part").select("p_partkey", F.coalesce(VP.wrong_variant(url, ids, pairs, F.array().cast("array<string>")), F.lit("")).alias("wrong"))


WRONG_VARIANTS = """
WITH k AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 8 = 0 END AS by_id, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS by_pair FROM part)
SELECT p_partkey, CASE WHEN (by_id IS NOT NULL OR by_pair IS NOT NULL) AND NOT coalesce(by_id, false) AND NOT coalesce(by_pair, false) THEN 'size=' || p_size || CASE WHEN by_id IS NOT NULL THEN '&variant=' || (p_partkey + 1000000) ELSE '' END ELSE '' END AS wrong FROM k
"""


def _proofs(spark, folder):
    """Customers as sources, their orders as proof pages, lines by flag as lists; the count is that of the lines flagged N."""
    n = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("path")).agg(F.count("*").alias("entries"))
    orders = table(spark, folder, "orders").select("o_custkey", F.col("o_orderkey").alias("url"), n.alias("n"), (F.col("o_orderkey") % 7 != 0).alias("captured"))
    lists = orders.join(lines, F.col("url") == F.col("l_orderkey")).select("o_custkey", "url", F.lit("api").alias("source"), "path", "entries")
    counts = lists.groupBy("o_custkey", "url").agg(F.max(F.when(F.col("path") == "N", F.col("entries"))).alias("count"))
    counted = orders.join(counts, ["o_custkey", "url"], "left").select("o_custkey", "url", "n", F.coalesce("count", F.lit(0)).alias("count"), F.when(F.col("count") > 0, "api").alias("source"), F.when(F.col("count") > 0, F.when(F.col("n") == 1, "R").otherwise("N")).alias("path"), "captured")
    return VP.certify_lists(counted, lists, ["o_custkey"])


def certified_lists(spark, folder):
    """The list that fits most proof pages of a source."""
    return _proofs(spark, folder)[0].select("o_custkey", "path", "fits")


def list_messages(spark, folder):
    """What the chosen list gets wrong on each proof page."""
    return _proofs(spark, folder)[1].select("o_custkey", F.col("url").alias("o_orderkey"), "status", F.coalesce("message", F.lit("")).alias("message"))


_PROOFS = """
WITH o AS (SELECT o_custkey, o_orderkey AS url, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey % 7 <> 0 AS captured FROM orders),
l AS (SELECT l_orderkey AS url, l_returnflag AS path, count(*) AS entries FROM lineitem GROUP BY 1, 2), k AS (SELECT o.*, coalesce(l.entries, 0) AS cnt FROM o LEFT JOIN l ON o.url = l.url AND l.path = 'N'),
c AS (SELECT o_custkey, CASE WHEN n = 1 THEN 'R' ELSE 'N' END AS path, min(n) AS first FROM k WHERE cnt > 0 GROUP BY 1, 2),
t AS (SELECT c.o_custkey, c.path, count(*) FILTER (coalesce(l.entries, 0) = k.cnt) AS fits, min(first) AS first FROM c JOIN k ON c.o_custkey = k.o_custkey AND captured LEFT JOIN l ON l.url = k.url AND l.path = c.path GROUP BY 1, 2),
b AS (SELECT o_custkey, path, fits FROM t QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY fits DESC, first) = 1)
"""
CERTIFIED_LISTS = _PROOFS + "SELECT o_custkey, path, fits FROM b"
LIST_MESSAGES = _PROOFS + """
, s AS (SELECT o_custkey, max(cnt) > 0 AS has FROM k GROUP BY 1), r AS (SELECT k.*, has, coalesce(l.entries, 0) AS found FROM k JOIN s ON k.o_custkey = s.o_custkey LEFT JOIN b ON k.o_custkey = b.o_custkey LEFT JOIN l ON l.url = k.url AND l.path = b.path)
SELECT o_custkey, url AS o_orderkey, CASE WHEN NOT captured THEN 'not_captured' WHEN NOT has THEN 'none' WHEN found <> cnt THEN 'failed' WHEN cnt = 0 THEN 'none' ELSE 'ok' END AS status,
  CASE WHEN NOT captured OR NOT has OR found = cnt THEN '' WHEN cnt = 0 THEN 'product ' || n || ' lists ' || found || ' variants — confirm them' WHEN found = 0 THEN 'found no variants on product ' || n
    WHEN found < cnt THEN 'found ' || found || ' of ' || cnt || ' variants on product ' || n ELSE 'found ' || found || ' variants on product ' || n || ', expected ' || cnt END AS message FROM r
"""


def same_entries(spark, folder):
    """Orders with two lines that read the same on flag and status."""
    return VP.same_entries(table(spark, folder, "lineitem"), ["l_orderkey"], "l_linenumber", ["l_returnflag", "l_linestatus"])


SAME_ENTRIES = """
WITH g AS (SELECT l_orderkey, l_returnflag || '/' || l_linestatus AS text, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
SELECT l_orderkey, arg_min(text, first || text) AS text FROM g GROUP BY 1
"""


def page_twins(spark, folder):
    """Leaves of an order's third line read as the page's own entry, and paths with that step led back to it."""
    leaves = J.leaf_table(_bodies(spark, folder), ["l_orderkey"], "body", J.CANDIDATES)
    chosen = table(spark, folder, "lineitem").select("l_orderkey").distinct().select("l_orderkey", F.lit("rows").alias("list_path"), F.lit(2).alias("item"))
    twins = VP.page_twins(leaves, chosen, ["l_orderkey"]).where(F.contains("path", F.lit("[page]")))
    return twins.select("l_orderkey", "path", "value", VP.on_page(F.col("path"), F.lit("rows"), F.lit(2)).alias("own"))


PAGE_TWINS = """
WITH l AS (SELECT l_orderkey, l_partkey, l_returnflag, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) = 3)
SELECT l_orderkey, 'rows[page].' || p AS path, v AS value, 'rows[2].' || p AS own FROM (SELECT l_orderkey, unnest(['sku', 'color', 'offers.price']) AS p, unnest([CAST(l_partkey AS VARCHAR), l_returnflag, CAST(l_linenumber AS VARCHAR)]) AS v FROM l)
"""


def assembled_export(spark, folder):
    """Orders with their lines as a customer gets them: one row a variant, under the customer's names."""
    fields = [{"key": "o_orderstatus", "name": "State"}, {"key": "l_returnflag", "name": "State", "level": "axis"}, {"key": "l_partkey", "name": "Part", "level": "variant"}]
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag", "l_partkey", "l_linenumber", "l_quantity")
    rows = table(spark, folder, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).withColumns({"_product_key": F.col("o_orderkey").cast("string"), "_variant_key": F.col("l_partkey").cast("string")})
    return X.assemble(rows, fields, "nested", ["l_linenumber", "l_partkey", "l_returnflag"])[1]


ASSEMBLED_EXPORT = """
SELECT any_value(o_orderstatus) AS "State", string_agg(l_returnflag, '; ' ORDER BY l_linenumber, l_partkey, l_returnflag) AS "State (2)", string_agg(CAST(l_partkey AS VARCHAR), '; ' ORDER BY l_linenumber, l_partkey, l_returnflag) AS "Part", CAST(o_orderkey AS VARCHAR) AS product_key
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
"""


def http_urls(spark, folder):
    """Addresses as links give them on a page: relative, with a fragment, of other schemes, in capitals."""
    n, u = F.col("page_id"), U.without_fragment(F.col("url"))
    link = F.when(n % 5 == 0, F.concat(F.lit(" /p/"), n.cast("string"), F.lit("#top"))).when(n % 5 == 1, F.concat(F.lit("HTTPS://Shop.Example.COM/A"), n.cast("string"))).when(n % 5 == 2, F.lit("#only")).when(n % 5 == 3, F.lit("mailto:a@b.c")).otherwise(u)
    return table(spark, folder, "pages").select("page_id", F.coalesce(U.http_url(link, F.col("url")), F.lit("")).alias("url"))


HTTP_URLS = _PARTS + r"""
SELECT page_id, CASE page_id % 5 WHEN 0 THEN scheme || '://' || host || '/p/' || page_id WHEN 1 THEN 'https://shop.example.com/A' || page_id WHEN 4 THEN regexp_replace(url, '#.*$', '') ELSE '' END AS url FROM s
"""


def rendered_values(spark, folder):
    """Normalised texts as typed values: prices, yes and no, lists."""
    price = F.concat(F.lit("$ "), F.format_number("o_totalprice", 2))
    told = F.when(F.col("o_orderstatus") == "F", "In stock").when(F.col("o_orderstatus") == "O", "no").otherwise("perhaps")
    words = F.concat(F.lit("b, "), "o_orderpriority", F.lit("; B"))
    value = lambda kind, raw: S.render_value(kind, S.normalize(kind, raw, fold=False))
    rows = table(spark, folder, "orders").select("o_orderkey", price.alias("p"), told.alias("t"), words.alias("w"))
    return rows.select("o_orderkey", F.floor(value("money", F.col("p")) * 100 + 0.5).alias("cents"), F.coalesce(value("boolean", F.col("t")).cast("string"), F.lit("")).alias("told"), F.array_join(value("text_list", F.col("w")), "|").alias("words"))


RENDERED_VALUES = """
SELECT o_orderkey, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents, CASE o_orderstatus WHEN 'F' THEN 'true' WHEN 'O' THEN 'false' ELSE '' END AS told,
  array_to_string(list_sort(list_distinct(['b', lower(o_orderpriority)])), '|') AS words FROM orders
"""


def shown_texts(spark, folder):
    """Names as pages show them: entities, marks of symbols, blanks, capitals."""
    raw = F.concat(F.lit(" <"), F.upper("p_name"), F.lit("> &amp; Co &reg;  "), "p_brand", F.lit("&nbsp;™ x"))
    return table(spark, folder, "part").select("p_partkey", H.shown_key(raw).alias("shown"))


SHOWN_TEXTS = "SELECT p_partkey, '<' || lower(p_name) || '> & co®' || lower(p_brand) || '™x' AS shown FROM part"


def clean_pages(spark, folder):
    """Pages without comments, scripts, styles and head."""
    bare = H.clean_html(F.col("html"))
    return table(spark, folder, "pages").select("page_id", F.length(bare).cast("long").alias("chars"), F.md5(bare).alias("digest"))


CLEAN_PAGES = r"""
WITH a AS (SELECT page_id, regexp_replace(html, '<!--(?s:.*?)-->', '', 'g') AS x FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(x, '(?is)<head\b[^>]*>.*?</head\s*>', '', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g') AS x FROM a),
c AS (SELECT page_id, trim(regexp_replace(regexp_replace(x, '(?i)<(link|meta)\b[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS x FROM b)
SELECT page_id, length(x) AS chars, md5(x) AS digest FROM c
"""


def _candidates(spark, folder):
    lines = table(spark, folder, "lineitem")
    flag = F.when(F.col("l_quantity") > 25, F.col("l_returnflag"))
    return lines.select("l_orderkey", F.lit("flag").alias("field"), (F.col("l_linenumber") % 3).alias("tier"), F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_quantity").alias("place"), flag.alias("value"), (F.col("l_linenumber") % 2 == 0).alias("stored"))


def tier_values(spark, folder):
    """Lines as candidates in three tiers: per order the first valid one of the lowest tier."""
    found = E.first_tier(_candidates(spark, folder), ["l_orderkey"], F.col("value").isNotNull())
    return found.select("l_orderkey", F.col("tier").cast("long").alias("tier"), "value")


TIER_VALUES = """
SELECT l_orderkey, CAST(l_linenumber % 3 AS BIGINT) AS tier, l_returnflag AS value FROM lineitem WHERE l_quantity > 25
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 3, l_linenumber, l_partkey, l_returnflag, l_quantity) = 1
"""


def charged_misses(spark, folder):
    """Stored candidates whose value was refused, per order."""
    return E.rejected(_candidates(spark, folder), F.col("value").isNotNull()).groupBy("l_orderkey").agg(F.count("*").alias("misses"))


CHARGED_MISSES = "SELECT l_orderkey, count(*) AS misses FROM lineitem WHERE l_quantity <= 25 AND l_linenumber % 2 = 0 GROUP BY 1"


def found_candidates(spark, folder):
    """Leaves of an order that show a wanted part number, as a number."""
    leaves = J.leaf_table(_bodies(spark, folder), ["l_orderkey"], "body", J.CANDIDATES)
    wanted = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.concat(F.min("l_partkey").cast("string"), F.lit(".00")).alias("expected"))
    equal = S.values_equal("number", F.col("value"), F.col("expected"), fold=False)
    return E.search_candidates(leaves, ["l_orderkey"], wanted, equal).where(F.col("path").endswith(".sku")).groupBy("l_orderkey").agg(F.count("*").alias("places"))


FOUND_CANDIDATES = """
SELECT l_orderkey, count(*) AS places FROM lineitem JOIN (SELECT l_orderkey AS k, min(l_partkey) AS p FROM lineitem GROUP BY 1) ON l_orderkey = k AND l_partkey = p GROUP BY 1
"""


def blanked_defaults(spark, folder):
    """Cells that a default filled, read as empty again."""
    filled = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("c_mktsegment"))).otherwise(F.array().cast("array<string>"))
    rows = CELLS.blank_defaulted(table(spark, folder, "customer").withColumn("defaulted", filled), ["c_mktsegment", "c_name"])
    return rows.select("c_custkey", F.coalesce("c_mktsegment", F.lit("")).alias("segment"), F.coalesce("c_name", F.lit("")).alias("name"))


BLANKED_DEFAULTS = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment, c_name AS name FROM customer"


QUERIES = {
    name: (globals()[name], globals()[name.upper()])
    for name in (
        "pagination", "card_groups", "walk_items", "walk_reports", "planned_addresses", "planned_reports", "direct_plans", "listing_api", "shown_values", "expected_errors", "address_forms", "label_forms", "canonical_paths", "flattened_responses",
        "array_paths", "entity_subtrees", "page_shapes", "page_hints", "fitting_shapes", "page_variants", "path_conflicts", "mechanical_values", "structured_pages", "json_requests", "value_search",
        "event_windows", "event_sessions", "string_paths", "collected_identifiers", "concept_candidates", "wrong_variants", "certified_lists", "list_messages", "same_entries", "page_twins",
        "assembled_export", "http_urls", "rendered_values", "shown_texts", "clean_pages", "tier_values", "charged_misses", "found_candidates", "blanked_defaults",
    )
}
