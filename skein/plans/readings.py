"""Queries of the reading family: where a long page is read, archives of pages, the extraction chain."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein.functions import html as H
from skein.operators import chain as C
from skein.operators import extract as E
from skein.operators import focus as O
from skein.operators.storage import shared_dir
from skein.sources import warc
from skein.sources.tables import table

_MOST = 6000


def _catalogue_pages(spark, folder):
    """Customers' orders as listing pages: a menu, then a piece of markup an order, of a kind by the customer; some name
    their results, have filters or a text that stands above the results."""
    kind, key = F.col("o_custkey") % 6, F.col("o_orderkey").cast("string")
    filler = F.repeat(F.lit("word "), (60 + F.col("o_orderkey") % 90 * (F.col("o_custkey") % 4)).cast("int"))
    link = F.concat(F.lit('<a href="/p/'), key, F.lit('?ref=x#top">'), key, F.lit("</a>"))
    body = (
        F.when(kind == 0, F.concat(F.lit('<div class="card '), F.lower("o_orderstatus"), F.lit('lat card">'), link, filler, F.lit("</div>")))
        .when(kind == 1, F.concat(F.lit("<ARTICLE><img alt='' src=\"/i/"), key, F.lit('.png">'), filler, F.lit("</ARTICLE>")))
        .when(kind == 2, F.concat(F.lit("<tr><td>"), link, F.lit("</td><td>"), filler, F.lit("</td></tr>")))
        .when(kind == 3, F.concat(F.lit('<img src="/i/'), key, F.lit('.png">'), F.substr(filler, F.lit(1), F.lit(150))))
        .when(kind == 4, F.concat(F.lit("<p>"), filler, F.lit("</p>")))
        .otherwise(F.concat(F.lit('<a href="https://shop.example.com/'), F.repeat(F.lit("ab"), 7), F.lit('/p">é'), filler, F.lit("</a>")))
    )
    pieces = table(spark, folder, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", body.alias("x")))).alias("a"))
    customer = F.col("o_custkey").cast("string")
    menu = F.concat(F.lit("<ul>"), F.repeat(F.lit('<li class="nav-item"><a href="/menu">m</a></li>'), 12), F.lit("</ul>"))
    filters = F.when(F.col("o_custkey") % 4 == 1, F.lit('<form id="price-Filter" aria-label="Sort by"></form>')).otherwise("")
    heading = F.when(F.col("o_custkey") % 5 < 2, F.concat(F.lit("<h2>Orders of <b>"), customer, F.lit("</b>, sorted</h2>"))).otherwise("")
    results = F.when(F.col("o_custkey") % 7 == 0, F.lit('<div role="skip to search-results"></div><ul id="Product-list">')).otherwise("")
    html = F.concat(F.lit("<html><body>"), menu, filters, heading, results, F.array_join(F.transform("a", lambda p: p["x"]), "\n"), F.lit("</body></html>"))
    landmark = F.when(F.col("o_custkey") % 5 == 0, F.lit("Orders of")).when(F.col("o_custkey") % 5 == 1, F.concat(F.lit("Orders of "), customer, F.lit(" (sorted)"))).when(F.col("o_custkey") % 5 == 2, F.lit("word"))
    return pieces.select("o_custkey", html.alias("html"), landmark.alias("landmark"))


def focus_of_listings(spark, folder):
    """Where listing pages made of orders are read, and what is read."""
    told = O.focus_windows(_catalogue_pages(spark, folder), ["o_custkey"], _MOST, landmark="landmark")
    return told.select("o_custkey", "strategy", "index", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


_CATALOGUE_PAGES = """
a AS (SELECT *, repeat('word ', CAST(60 + o_orderkey % 90 * (o_custkey % 4) AS INT)) AS filler, '<a href="/p/' || o_orderkey || '?ref=x#top">' || o_orderkey || '</a>' AS link FROM orders),
b AS (SELECT o_custkey, string_agg(CASE o_custkey % 6 WHEN 0 THEN '<div class="card ' || lower(o_orderstatus) || 'lat card">' || link || filler || '</div>' WHEN 1 THEN '<ARTICLE><img alt='''' src="/i/' || o_orderkey || '.png">' || filler || '</ARTICLE>'
    WHEN 2 THEN '<tr><td>' || link || '</td><td>' || filler || '</td></tr>' WHEN 3 THEN '<img src="/i/' || o_orderkey || '.png">' || substr(filler, 1, 150) WHEN 4 THEN '<p>' || filler || '</p>'
    ELSE '<a href="https://shop.example.com/ababababababab/p">é' || filler || '</a>' END, chr(10) ORDER BY o_orderkey) AS x FROM a GROUP BY 1),
src AS (SELECT o_custkey AS id, '<html><body><ul>' || repeat('<li class="nav-item"><a href="/menu">m</a></li>', 12) || '</ul>' || CASE WHEN o_custkey % 4 = 1 THEN '<form id="price-Filter" aria-label="Sort by"></form>' ELSE '' END
    || CASE WHEN o_custkey % 5 < 2 THEN '<h2>Orders of <b>' || o_custkey || '</b>, sorted</h2>' ELSE '' END || CASE WHEN o_custkey % 7 = 0 THEN '<div role="skip to search-results"></div><ul id="Product-list">' ELSE '' END || x || '</body></html>' AS html,
  CASE o_custkey % 5 WHEN 0 THEN 'Orders of' WHEN 1 THEN 'Orders of ' || o_custkey || ' (sorted)' WHEN 2 THEN 'word' END AS landmark,
  -- the words of the second kind of landmark: the customer's number counts from three digits on
  CASE WHEN o_custkey % 5 = 1 THEN CASE WHEN o_custkey >= 100 THEN ['(?i)orders[^a-z0-9]{1,80}' || o_custkey || '[^a-z0-9]{1,80}sorted', '(?i)orders[^a-z0-9]{1,80}' || o_custkey, '(?i)' || o_custkey || '[^a-z0-9]{1,80}sorted'] ELSE ['(?i)orders[^a-z0-9]{1,80}sorted'] END ELSE [] END AS runs FROM b)
"""

_FOCUS = r"""
big AS (SELECT * FROM src WHERE length(html) > {most}),
pat AS (SELECT * FROM (VALUES ('class', 'class="[^"]{{1,200}}"'), ('link', '(?i)<a\b[^>]*href="[^"]+"'), ('image', '(?i)<img\b[^>]*src="[^"]+"'), ('article', '(?i)<article\b'), ('li', '(?i)<li\b'), ('tr', '(?i)<tr\b'), ('section', '(?i)<section\b')) t(kind, rx)),
m AS (SELECT id, kind, string_split_regex(html, rx) AS p, regexp_extract_all(html, rx) AS f FROM big, pat),
o AS (SELECT id, kind, unnest(range(1, len(f) + 1)) AS i, p, f FROM m),
places AS (SELECT id, kind, f[i] AS found, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS pos FROM o),
hrefs AS (SELECT id, pos, regexp_replace(regexp_replace(regexp_replace(regexp_extract(found, '(?i)href="([^"]+)"', 1), '^https?://[^/?#]*', ''), '[?#].*$', ''), '^/*', '/') AS path FROM places WHERE kind = 'link'),
tokens AS (SELECT id, pos, unnest(list_filter(string_split_regex(regexp_extract(found, '"([^"]*)"', 1), '\s+'), lambda x: length(x) BETWEEN 3 AND 40)) AS token FROM places WHERE kind = 'class'),
points AS (SELECT id, 2 AS ladder, token, pos FROM tokens UNION ALL SELECT id, 3, regexp_replace(regexp_replace(path, '\d+', '#', 'g'), '(?i)[a-z0-9]{{12,}}', '*', 'g'), pos FROM hrefs WHERE path <> '/'
  UNION ALL SELECT id, 4, kind, pos FROM places WHERE kind IN ('article', 'li', 'tr', 'section') UNION ALL SELECT id, 5, '', pos FROM hrefs UNION ALL SELECT id, 6, '', pos FROM places WHERE kind = 'image'),
dense AS (SELECT *, count(*) OVER (PARTITION BY id, ladder, token ORDER BY pos RANGE BETWEEN CURRENT ROW AND {most} FOLLOWING) AS n FROM points),
started AS (SELECT id, ladder, token, min(pos) AS first, arg_max(pos, n * 1000000000 - pos) AS start, list_sort(list(pos)) AS every FROM dense GROUP BY 1, 2, 3),
held AS (SELECT *, list_filter(every, lambda p: p >= start AND p < start + {most}) AS ins FROM started),
gapped AS (SELECT *, len(ins) AS inside, list_sort(list_transform(range(2, len(ins) + 1), lambda i: ins[i] - ins[i - 1])) AS gaps FROM held),
scored AS (SELECT *, 0.55::DOUBLE * greatest(0::DOUBLE, least(1::DOUBLE, (coalesce(gaps[len(gaps) // 2 + 1], 0) - 300) / 2700)) + 0.25::DOUBLE * (least(inside, 12) / 12) + 0.2::DOUBLE * least(1::DOUBLE, (ins[-1] - ins[1]) / {most}) AS score FROM gapped),
rawed AS (SELECT *, CASE ladder WHEN 2 THEN score + CASE WHEN regexp_matches(token, '(?i)(grid|card|item|product|result|tile|cell|listing|entry|post|hit)') THEN 0.05::DOUBLE ELSE 0 END
    WHEN 4 THEN score * CASE token WHEN 'article' THEN 0.9::DOUBLE WHEN 'tr' THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END ELSE score END AS raw, CASE WHEN ladder = 4 THEN list_position(['article', 'li', 'tr', 'section'], token) ELSE first END AS turn
  FROM scored WHERE inside >= CASE ladder WHEN 5 THEN 10 WHEN 6 THEN 8 ELSE 5 END),
best AS (SELECT id, ladder, start AS index, CASE ladder WHEN 2 THEN least(0.9::DOUBLE, raw) WHEN 3 THEN least(0.88::DOUBLE, raw) WHEN 5 THEN least(0.75::DOUBLE, 0.3::DOUBLE + inside / 120) WHEN 6 THEN least(0.6::DOUBLE, 0.25::DOUBLE + inside / 100) ELSE raw END AS worth
  FROM rawed QUALIFY row_number() OVER (PARTITION BY id, ladder ORDER BY raw DESC, turn, token) = 1),
named AS (SELECT id, string_split_regex(html, '{results}') AS p, regexp_extract_all(html, '{results}') AS f, length(html) AS n FROM big),
shown AS (SELECT id, html, list_filter(runs, lambda r: regexp_matches(html, r))[1] AS run FROM big),
single AS (SELECT id, 1 AS ladder, n - length(p[-1]) - length(f[-1]) AS index, 0.92::DOUBLE AS worth FROM named WHERE len(f) > 0
  UNION ALL SELECT id, 7, greatest(strpos(html, 'id="price-Filter"'), strpos(html, 'aria-label="Sort by"')) - 1, 0.45 FROM big WHERE contains(html, 'price-Filter')
  UNION ALL SELECT id, 0, length(html) - length(string_split(html, landmark)[-1]) - length(landmark), CASE WHEN len(string_split(html, landmark)) = 2 THEN 0.95 ELSE 0.6 END FROM big WHERE contains(html, landmark)
  UNION ALL SELECT s.id, 0, length(s.html) - length(string_split_regex(s.html, run)[-1]) - length(regexp_extract_all(s.html, run)[-1]), 0.91 FROM shown s JOIN big USING (id) WHERE run IS NOT NULL AND NOT contains(s.html, landmark)),
won AS (SELECT * FROM (SELECT * FROM best UNION ALL SELECT * FROM single) QUALIFY row_number() OVER (PARTITION BY id ORDER BY worth DESC, ladder) = 1),
told AS (SELECT src.id, html, CASE WHEN length(html) <= {most} THEN 'whole-document' ELSE coalesce(['landmark', 'results-attribute', 'repeated-class', 'link-shape', 'semantic-repeat', 'link-density', 'image-cluster', 'filter-nav'][ladder + 1], 'head-of-document') END AS strategy,
  CAST(coalesce(greatest(0, index - {lead}), 0) AS BIGINT) AS index FROM src LEFT JOIN won USING (id)),
cut AS (SELECT id, strategy, index, CASE WHEN index = 0 OR NOT contains(substr(html, index + 1), '<') THEN substr(html, index + 1) ELSE substr(html, index + strpos(substr(html, index + 1), '<')) END AS rest FROM told),
piece AS (SELECT id, strategy, index, rest, substr(rest, 1, {most}) AS x FROM cut),
whole AS (SELECT id, strategy, index, CASE WHEN strategy = 'whole-document' OR length(x) < {most} OR length(x) - length(string_split(x, '>')[-1]) <= 1 THEN x ELSE substr(x, 1, length(x) - length(string_split(x, '>')[-1])) END AS text FROM piece)
"""


def _focus(source: str, most: int, keys: str) -> str:
    return f"WITH {source.strip()}, {_FOCUS.format(most=most, lead=most // 20, results=O.RESULTS_ATTRIBUTE).strip()}\nSELECT {keys}, strategy, index, length(text) AS chars, md5(text) AS digest FROM whole"


def focus_of_pages(spark, folder):
    """Where the pages are read of which 1,500 characters may be."""
    told = O.focus_windows(table(spark, folder, "pages"), ["page_id"], 1500)
    return told.select("page_id", "strategy", "index", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


def archived_pages(spark, folder):
    """Pages written as archive records and read again, with what the records say of them."""
    path = f"{shared_dir(spark)}/skein-warc-{uuid.uuid4().hex}"
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id"))
    warc.write_warc(table(spark, folder, "pages"), path, at, F.when(F.col("page_id") % 9 == 0, 404).otherwise(200))
    return warc.responses(spark, path).select("url", F.unix_timestamp("at").alias("at"), F.col("status").cast("long").alias("status"), F.length("html").cast("long").alias("chars"), F.md5("html").alias("digest"))


ARCHIVED_PAGES = "SELECT url, 1700000000 + page_id AS at, CASE WHEN page_id % 9 = 0 THEN 404 ELSE 200 END AS status, length(html) AS chars, md5(html) AS digest FROM pages"


_FIELDS = [("product_name", "string", False), ("price", "number", False), ("detail_url", "string", True), ("description", "string", False)]


def _chain(spark, folder):
    """Pages with candidates of many tiers: the next page's heading as a recorded response, captions, short and empty texts,
    what is no number, addresses of the page where a row's are wanted."""
    pages, p = table(spark, folder, "pages"), F.col("page_id")
    h1, link, first = (F.regexp_extract("html", x, 1) for x in ("<h1>([^<]*)</h1>", '<a href="([^"]*)"', "<p>([^<]*)"))
    after = pages.select((p - 1).alias("page_id"), h1.alias("other"))
    own = pages.select("page_id", "url", h1.alias("h1"), link.alias("link"), first.alias("first")).join(after, "page_id", "left")
    none = F.lit(None).cast("string")

    def made(field, tier, source, path, value, place=0, worth=0.5):
        return F.struct(*[F.lit(x).alias(n) for n, x in (("field", field), ("tier", tier), ("source", source), ("path", path), ("place", place))], F.lit(worth).cast("double").alias("confidence"), value.cast("string").alias("value"))

    name, number = F.col("h1"), p.cast("string")
    rows = F.array(
        made("product_name", "selected", "json-ld", "name", F.when(p % 11 == 0, name)),
        made("product_name", "mechanical", "api", "item.title", F.col("other")),
        made("product_name", "cached", "api", "data.name", F.when(p % 2 == 0, F.lit(" Reviews "))),
        made("product_name", "cached", "api", "data.title", F.when(p % 3 > 0, F.concat("other", F.lit(" zq"), number)), 1, 0.75),
        made("product_name", "cached-xpath", "xpath-cached", "//h1", F.when(p % 3 > 0, name)),
        made("product_name", "override", "xpath", "//h2", F.when(p % 7 == 0, F.when(p % 2 == 0, F.lit("Add to cart")).otherwise(F.concat(F.lit("Chosen "), number)))),
        made("product_name", "xpath", "xpath", "//title", name),
        made("price", "mechanical", "meta", "price", F.when(p % 4 == 0, F.lit("n/a")).when(p % 4 > 1, F.concat(F.lit("$"), number, F.lit(".5")))),
        made("price", "cached", "api", "offer.price", F.when(p % 3 == 0, F.lit("€ 1,234")).otherwise("ask")),
        made("price", "xpath", "xpath", "//b", number),
        made("detail_url", "mechanical", "meta", "og:url", F.col("url")),
        made("detail_url", "cached", "api", "link", F.col("url")),
        made("detail_url", "xpath", "xpath", "//a/@href", F.col("link")),
        made("description", "mechanical", "json-ld", "description", F.when(p % 3 == 0, F.lit("Short one")).when(p % 3 == 1, F.lit("Description"))),
        made("description", "cached-xpath", "xpath-cached", "//p", F.col("first")),
        made("description", "vision", "ai-vision", "", none),
        made("unknown", "xpath", "xpath", "//i", number),
    )
    candidates = own.select("page_id", F.inline(rows))
    fields = spark.createDataFrame(_FIELDS, "field string, type string, row_scoped boolean")
    text = pages.select("page_id", H.visible_text(F.col("html")).alias("page_text"))
    return C.decide(C.judged(candidates, fields, text, ["page_id"]), ["page_id"])


def chain_values(spark, folder):
    """The value of each page's field, with the tier that gave it."""
    return C.chain_values(_chain(spark, folder), ["page_id"])


def chain_outcomes(spark, folder):
    """How often each tier's candidates were taken, replaced, refused (and why) or not asked."""
    told = _chain(spark, folder).groupBy("field", "tier", "outcome", F.when(F.col("outcome") == "refused", F.col("refused")).otherwise("").alias("reason"))
    return told.agg(F.count("*").alias("candidates"))


def chain_learned(spark, folder):
    """Stored paths after the chain's hits and charged misses."""
    seen = C.chain_observations(_chain(spark, folder), ["page_id"]).withColumns({"seq": F.col("page_id"), "at": F.col("page_id").cast("string")})
    known = [("product_name", "api", "data.title", 0.9, 5, 1), ("price", "api", "offer.price", 0.4, 2, 0)]
    stored = spark.createDataFrame(known, "field string, source string, path string, confidence double, hits long, misses long")
    stored = stored.select("*", F.lit(None).cast("string").alias("last_value"), F.lit(None).cast("string").alias("last_used_at"), F.lit(False).alias("pinned"))
    return E.merge_observations(stored, seen, ["field"]).select("field", "source", "path", "hits", "misses", F.coalesce("last_value", F.lit("")).alias("last_value"))


_CHAIN = r"""
WITH p AS (SELECT page_id AS k, CAST(page_id AS VARCHAR) AS s, url, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1, regexp_extract(html, '<a href="([^"]*)"', 1) AS link, regexp_extract(html, '<p>([^<]*)', 1) AS first,
  lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g'))) AS seen FROM pages),
o AS (SELECT p.*, q.h1 AS other FROM p LEFT JOIN p q ON q.k = p.k + 1),
c AS (SELECT k, seen, 'product_name' AS field, 1 AS turn, 0 AS place, 'selected' AS tier, 'json-ld' AS source, 'name' AS path, CASE WHEN k % 11 = 0 THEN h1 END AS value, 0.95::DOUBLE AS confidence FROM o
  UNION ALL SELECT k, seen, 'product_name', 4, 0, 'mechanical', 'api', 'item.title', other, 0.8 FROM o
  UNION ALL SELECT k, seen, 'product_name', 5, 0, 'cached', 'api', 'data.name', CASE WHEN k % 2 = 0 THEN ' Reviews ' END, 0.5 FROM o
  UNION ALL SELECT k, seen, 'product_name', 5, 1, 'cached', 'api', 'data.title', CASE WHEN k % 3 > 0 THEN other || ' zq' || s END, 0.75 FROM o
  UNION ALL SELECT k, seen, 'product_name', 6, 0, 'cached-xpath', 'xpath-cached', '//h1', CASE WHEN k % 3 > 0 THEN h1 END, 0.85 FROM o
  UNION ALL SELECT k, seen, 'product_name', 7, 0, 'override', 'xpath', '//h2', CASE WHEN k % 14 = 0 THEN 'Add to cart' WHEN k % 7 = 0 THEN 'Chosen ' || s END, 0.95 FROM o
  UNION ALL SELECT k, seen, 'product_name', 11, 0, 'xpath', 'xpath', '//title', h1, 0.7 FROM o
  UNION ALL SELECT k, seen, 'price', 4, 0, 'mechanical', 'meta', 'price', CASE k % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN NULL ELSE '$' || s || '.5' END, 0.8 FROM o
  UNION ALL SELECT k, seen, 'price', 5, 0, 'cached', 'api', 'offer.price', CASE k % 3 WHEN 0 THEN '€ 1,234' ELSE 'ask' END, 0.5 FROM o
  UNION ALL SELECT k, seen, 'price', 11, 0, 'xpath', 'xpath', '//b', s, 0.7 FROM o
  UNION ALL SELECT k, seen, 'detail_url', 4, 0, 'mechanical', 'meta', 'og:url', url, 0.8 FROM o
  UNION ALL SELECT k, seen, 'detail_url', 5, 0, 'cached', 'api', 'link', url, 0.5 FROM o
  UNION ALL SELECT k, seen, 'detail_url', 11, 0, 'xpath', 'xpath', '//a/@href', link, 0.7 FROM o
  UNION ALL SELECT k, seen, 'description', 4, 0, 'mechanical', 'json-ld', 'description', CASE k % 3 WHEN 0 THEN 'Short one' WHEN 1 THEN 'Description' END, 0.8 FROM o
  UNION ALL SELECT k, seen, 'description', 6, 0, 'cached-xpath', 'xpath-cached', '//p', first, 0.85 FROM o
  UNION ALL SELECT k, seen, 'description', 12, 0, 'vision', 'ai-vision', '', NULL, 0.5 FROM o),
w AS (SELECT *, list_filter(string_split(lower(value), ' '), lambda x: length(x) >= 3) AS words, TRY_CAST(regexp_replace(value, '[$,€£¥\s]', '', 'g') AS DOUBLE) AS number FROM c),
j AS (SELECT *, CASE WHEN value IS NULL THEN 'absent' WHEN field = 'detail_url' AND source <> 'xpath' THEN 'row-scoped' WHEN field = 'price' AND number IS NULL THEN 'not numeric' WHEN field = 'price' THEN NULL WHEN trim(value) = '' THEN 'empty string'
    WHEN lower(trim(value)) IN ('reviews', 'add to cart', 'description') THEN 'looks like UI label' WHEN field = 'description' AND length(trim(value)) < 20 THEN 'description too short'
    WHEN field = 'product_name' AND source = 'api' AND seen <> '' AND len(words) > 0 AND len(list_filter(words, lambda x: contains(seen, x))) / len(words) < 0.6 THEN 'not corroborated' END AS refused,
  CASE WHEN field = 'price' THEN CAST(number AS VARCHAR) ELSE value END AS normal, turn * 10 + place AS pos FROM w),
f AS (SELECT *, min(CASE WHEN refused IS NULL AND tier <> 'override' THEN pos END) OVER q AS plain, min(CASE WHEN refused IS NULL AND tier = 'override' THEN pos END) OVER q AS over FROM j WINDOW q AS (PARTITION BY k, field)),
d AS (SELECT *, CASE WHEN tier = 'override' AND plain < 30 OR tier <> 'override' AND pos > least(plain, CASE WHEN plain < 30 THEN plain ELSE over END) THEN 'not asked' WHEN refused IS NOT NULL THEN 'refused'
    WHEN tier = 'override' OR over IS NULL OR plain < 30 THEN 'taken' WHEN pos < over THEN 'overridden' ELSE 'not asked' END AS outcome FROM f)
"""

CHAIN_VALUES = _CHAIN + "SELECT k AS page_id, field, normal AS value, source, path, tier, confidence FROM d WHERE outcome = 'taken'"
CHAIN_OUTCOMES = _CHAIN + "SELECT field, tier, outcome, CASE WHEN outcome = 'refused' THEN refused ELSE '' END AS reason, count(*) AS candidates FROM d GROUP BY ALL"
CHAIN_LEARNED = _CHAIN + """, s AS (SELECT field, source, path, count(*) FILTER (outcome = 'taken') AS hits, count(*) FILTER (outcome <> 'taken') AS misses, arg_max(CASE WHEN outcome = 'taken' THEN normal END, CASE WHEN outcome = 'taken' THEN k END) AS last_value
  FROM d WHERE path <> '' AND (outcome = 'taken' OR outcome = 'refused' AND tier IN ('cached', 'cached-xpath') AND refused <> 'row-scoped') GROUP BY 1, 2, 3),
known(field, source, path, hits, misses) AS (VALUES ('product_name', 'api', 'data.title', 5, 1), ('price', 'api', 'offer.price', 2, 0))
SELECT field, source, path, CAST(coalesce(s.hits, 0) + coalesce(known.hits, 0) AS BIGINT) AS hits, CAST(coalesce(s.misses, 0) + coalesce(known.misses, 0) AS BIGINT) AS misses, coalesce(last_value, '') AS last_value FROM s FULL JOIN known USING (field, source, path)
"""

QUERIES = {
    "focus_of_listings": (focus_of_listings, _focus(_CATALOGUE_PAGES, _MOST, "id AS o_custkey")),
    "focus_of_pages": (focus_of_pages, _focus("src AS (SELECT page_id AS id, html, NULL::VARCHAR AS landmark, []::VARCHAR[] AS runs FROM pages)", 1500, "id AS page_id")),
    "archived_pages": (archived_pages, ARCHIVED_PAGES),
    "chain_values": (chain_values, CHAIN_VALUES),
    "chain_outcomes": (chain_outcomes, CHAIN_OUTCOMES),
    "chain_learned": (chain_learned, CHAIN_LEARNED),
}
