"""Queries of the page family: URL keys, page text and health, links, pagination, groups, requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import html as H
from skein.functions import urls as U
from skein.operators import contract
from skein.operators import pages as P
from skein.operators.ranking import API_URL_WORDS, CONFIG_KEYS, NEGATIVE_URL_WORDS, PRODUCT_KEYS, PRODUCT_URL_WORDS, RELATION_URL_WORDS, WEIGHTS, analysis_sources, dense_window, hits, rank_requests, request_score
from skein.sources.tables import table

_PARTS = r"""
WITH u AS (SELECT page_id, url, html, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path,
  regexp_extract(url, '\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS ref FROM pages),
s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg, list_filter(string_split(query, '&'), lambda x: x <> '') AS pairs, regexp_replace(host, '^www\.', '') AS bare, string_split(host, '.') AS labels FROM u)
"""
_SHAPED = r"""'/' || array_to_string(list_transform(seg, lambda x: CASE WHEN regexp_matches(regexp_replace(x, '\.[A-Za-z]{2,5}$', ''), '[0-9_-]') OR length(regexp_replace(x, '\.[A-Za-z]{2,5}$', '')) >= 12 THEN '*' || regexp_extract(x, '(\.[A-Za-z]{2,5})$', 1) ELSE x END), '/')"""


def url_keys(spark, folder):
    u = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id",
        U.bare_host(u).alias("host"),
        U.root_domain(U.host(u)).alias("root"),
        U.brand(U.host(u)).alias("brand"),
        F.coalesce(U.subdomain_prefix(U.host(u)), F.lit("")).alias("prefix"),
        U.url_shape(u).alias("shape"),
        U.product_key(u).alias("product_key"),
        U.address_pattern(u).alias("pattern"),
        U.response_key(u).alias("response"),
        U.without_fragment(u).alias("bare"),
        F.coalesce(U.last_identifier(u), F.lit("")).alias("identifier"),
        F.array_join(U.url_words(u), " ").alias("words"),
    )


URL_KEYS = _PARTS + rf"""
, k AS (SELECT *, array_to_string(labels[-2:], '.') AS root FROM s)
SELECT page_id, bare AS host, root, split_part(root, '.', 1) AS brand, CASE WHEN length(bare) > length(root) THEN left(bare, length(bare) - length(root) - 1) ELSE '' END AS prefix, bare || {_SHAPED} AS shape,
  bare || rtrim(path, '/') AS product_key, regexp_replace(path, '\d+', 'n', 'g') || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(list_sort(list_distinct(list_transform(pairs, lambda p: split_part(p, '=', 1)))), '&') ELSE '' END AS pattern,
  scheme || '://' || host || path AS response, regexp_replace(url, '#.*$', '') AS bare, CASE WHEN length(seg[-1]) >= 6 THEN seg[-1] ELSE '' END AS identifier, array_to_string(list_filter(string_split_regex(lower(path), '[^a-z0-9]+'), lambda x: x <> ''), ' ') AS words FROM k
"""


def variant_pairs(spark, folder):
    """Pairs that may name a variant, on addresses with one added to every third page, behind its query and before its fragment."""
    address, fragment = U.without_fragment(F.col("url")), F.regexp_extract("url", "(?s)#.*$", 0)
    added = F.concat(address, F.when(F.contains(address, F.lit("?")), F.lit("&")).otherwise(F.lit("?")), F.lit("color=Red&size=M"), fragment)
    pages = table(spark, folder, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, added).otherwise(F.col("url")).alias("u"))
    pairs = F.transform(F.array_sort(F.map_entries(U.variant_pairs(F.col("u")))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return pages.select("page_id", F.array_join(pairs, "&").alias("pairs"))


VARIANT_PAIRS = _PARTS + rf"""
, a AS (SELECT page_id, list_concat(CASE WHEN page_id % 3 = 0 THEN list_append(pairs, 'color=Red') ELSE pairs END, CASE WHEN page_id % 3 = 0 THEN ['size=M'] ELSE [] END,
  CASE WHEN regexp_matches(ref, '^[A-Za-z_][\w.-]*=[^&]*(&[A-Za-z_][\w.-]*=[^&]*)*$') THEN string_split(ref, '&') ELSE [] END) AS every FROM s),
p AS (SELECT page_id, unnest(every) AS p, unnest(range(len(every))) AS n FROM a),
k AS (SELECT page_id, split_part(p, '=', 1) AS k, arg_max(regexp_replace(p, '^[^=]*=?', ''), n) AS v FROM p
  WHERE trim(split_part(p, '=', 1)) <> '' AND trim(regexp_replace(p, '^[^=]*=?', '')) <> '' AND NOT regexp_matches(split_part(p, '=', 1), '{U.NOISE_KEYS}') GROUP BY 1, 2)
SELECT page_id, coalesce(string_agg(k || '=' || v, '&' ORDER BY k), '') AS pairs FROM pages LEFT JOIN k USING (page_id) GROUP BY 1
"""


def page_text(spark, folder):
    """Length and digest of a page's visible text, with its heading."""
    text = H.visible_text(F.col("html"))
    return table(spark, folder, "pages").select("page_id", F.length(text).cast("long").alias("chars"), F.md5(text).alias("digest"), F.length(H.visible_text(F.col("html"), keep_comments=True)).cast("long").alias("chars_with_comments"), F.md5(H.page_heading(F.col("html"))).alias("heading"))


PAGE_TEXT = r"""
WITH a AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(html, '<!--(?s:.*?)-->', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g') AS x,
  regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g') AS y, regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1) AS h FROM pages),
t AS (SELECT page_id, trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS t, trim(regexp_replace(regexp_replace(y, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS w, trim(regexp_replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS h FROM a)
SELECT page_id, length(t) AS chars, md5(t) AS digest, length(w) AS chars_with_comments, md5(h) AS heading FROM t
"""


def page_verdicts(spark, folder):
    """Verdicts over pages with made-up statuses: some refused, some not found, some moved."""
    status = F.when(F.col("page_id") % 10 == 0, 404).when(F.col("page_id") % 10 == 1, 503).otherwise(200)
    final = F.when(F.col("page_id") % 10 == 2, F.lit("https://login.elsewhere.example.io/")).otherwise(F.col("url"))
    thin = F.when(F.col("page_id") % 10 == 3, F.lit("<html><body>Just a moment</body></html>")).when(F.col("page_id") % 10 == 4, F.lit("<html><body>Access denied</body></html>")).otherwise(F.col("html"))
    rows = table(spark, folder, "pages").select("page_id", "url", status.alias("status"), final.alias("final"), thin.alias("html"), H.title(thin).alias("title"))
    return P.with_verdict(rows, "html", "title", "status", "url", "final").select("page_id", "verdict")


PAGE_VERDICTS = _PARTS + r"""
, t AS (SELECT page_id, html, lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS head, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--(?s:.*?)-->', ' ', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM s)
SELECT page_id, CASE page_id % 10 WHEN 0 THEN 'not-found' WHEN 1 THEN 'refused' WHEN 2 THEN 'redirected' WHEN 3 THEN 'challenge' WHEN 4 THEN 'refused' ELSE CASE WHEN length(text) < 100 THEN 'blank' ELSE 'ok' END END AS verdict FROM t
"""

_LINKS = _PARTS + r"""
, a AS (SELECT page_id, url, scheme, host, regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>') AS links FROM s),
l AS (SELECT page_id, url AS page, scheme, host, generate_subscripts(links, 1) - 1 AS pos, unnest(links) AS link FROM a),
h AS (SELECT page_id, page, host, pos, replace(regexp_extract(link, '(?i)\bhref=["'']([^"'']*)["'']', 1), '&amp;', '&') AS href, scheme FROM l),
r AS (SELECT *, regexp_replace(CASE WHEN href LIKE '/%' AND href NOT LIKE '//%' THEN scheme || '://' || host || href WHEN regexp_matches(href, '(?i)^https?://') THEN href END, '#.*$', '') AS url FROM h)
"""


def _links(spark, folder):
    return P.link_table(table(spark, folder, "pages"), "page_id", "url", "html")


def links(spark, folder):
    return _links(spark, folder).select("page_id", F.col("pos").cast("long").alias("pos"), "href", "url")


LINKS = _LINKS + "SELECT page_id, CAST(pos AS BIGINT) AS pos, href, url FROM r"


def detail_links(spark, folder):
    """Each address of a host once, at its first place over the host's pages."""
    linked = _links(spark, folder).withColumn("host", U.host(F.col("_page")))
    return P.detail_links(linked, ["host"], ["page_id", "pos"]).select("host", "url", "page_id", F.col("pos").cast("long").alias("pos"))


DETAIL_LINKS = _LINKS + """
SELECT host, url, page_id, CAST(pos AS BIGINT) AS pos FROM r WHERE url IS NOT NULL AND url <> regexp_replace(page, '#.*$', '') QUALIFY row_number() OVER (PARTITION BY host, url ORDER BY page_id, pos) = 1
"""


def work_list(spark, folder):
    """Planned items: addresses once over all hosts of a domain, two per page at most."""
    linked = _links(spark, folder).withColumn("root", U.root_domain(U.host(F.col("_page")))).where("url IS NOT NULL")
    return P.planned_items(linked, ["root"], "page_id", ["page_id", "pos"], 2).select("root", "url", "page_id", F.col("place").cast("long").alias("place"), "status")


WORK_LIST = _LINKS + """
, f AS (SELECT array_to_string(string_split(host, '.')[-2:], '.') AS root, url, page_id, pos FROM r WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY root, url ORDER BY page_id, pos) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY root, page_id ORDER BY page_id, pos) AS place FROM f)
SELECT root, url, page_id, place, CASE WHEN place <= 2 THEN 'planned' ELSE 'skipped_budget' END AS status FROM n
"""


def outlinks(spark, folder):
    linked = _links(spark, folder).where("url IS NOT NULL").select(U.bare_host(F.col("_page")).alias("host"), "url")
    return linked.groupBy("host").agg(F.count("*").alias("links"), F.count_distinct("url").alias("targets"))


OUTLINKS = _LINKS + "SELECT regexp_replace(host, '^www\\.', '') AS host, count(*) AS links, count(DISTINCT url) AS targets FROM r WHERE url IS NOT NULL GROUP BY 1"


def shape_groups(spark, folder):
    """Pages of a root domain by shape: the product keys of each and its rank."""
    pages = table(spark, folder, "pages").select(U.root_domain(U.host(F.col("url"))).alias("root"), F.col("page_id").alias("pos"), "url")
    groups = P.product_groups(pages, ["root"], least=2)
    return groups.select("root", "shape", "keys", F.col("first").cast("long").alias("first"), F.col("rank").cast("long").alias("rank"))


SHAPE_GROUPS = _PARTS + rf"""
, k AS (SELECT array_to_string(labels[-2:], '.') AS root, page_id, bare || {_SHAPED} AS shape, bare || rtrim(path, '/') AS key FROM s),
g AS (SELECT root, shape, count(DISTINCT key) AS keys, min(page_id) AS first FROM k GROUP BY 1, 2 HAVING count(DISTINCT key) >= 2)
SELECT *, row_number() OVER (PARTITION BY root ORDER BY keys DESC, first) AS rank FROM g
"""


def merged_shapes(spark, folder):
    pages = table(spark, folder, "pages").select(U.root_domain(U.host(F.col("url"))).alias("root"), F.col("page_id").alias("pos"), "url")
    return P.merged_shapes(P.product_groups(pages, ["root"], least=1), ["root"], shapes=2, keys=1)


MERGED_SHAPES = _PARTS + rf"""
, k AS (SELECT array_to_string(labels[-2:], '.') AS root, bare || {_SHAPED} AS shape, bare || rtrim(path, '/') AS key FROM s), g AS (SELECT root, shape, count(DISTINCT key) AS keys FROM k GROUP BY 1, 2),
p AS (SELECT root, shape, keys, string_split(shape, '/') AS parts FROM g), h AS (SELECT root, shape, keys, parts, unnest(range(2, len(parts) + 1)) AS i FROM p),
m AS (SELECT root, keys, array_to_string(parts[:i - 1] || ['*'] || parts[i + 1:], '/') AS merged FROM h)
SELECT root, merged, count(*) AS shapes, CAST(sum(keys) AS BIGINT) AS keys FROM m GROUP BY 1, 2 HAVING count(*) >= 2
"""


def page_parameters(spark, folder):
    """Numeric query parameters over a root domain's addresses."""
    pages = table(spark, folder, "pages").select(U.root_domain(U.host(F.col("url"))).alias("root"), "url")
    return P.page_parameters(pages, ["root"]).select("root", "param", "distinct_values", "stride_one", F.col("rank").cast("long").alias("rank"))


PAGE_PARAMETERS = _PARTS + r"""
, q AS (SELECT array_to_string(labels[-2:], '.') AS root, unnest(pairs) AS p FROM s), v AS (SELECT DISTINCT root, split_part(p, '=', 1) AS param, TRY_CAST(split_part(p, '=', 2) AS BIGINT) AS value FROM q WHERE regexp_matches(p, '=\d+$')),
d AS (SELECT *, value - lag(value) OVER (PARTITION BY root, param ORDER BY value) = 1 AS one FROM v),
g AS (SELECT root, param, count(*) AS distinct_values, coalesce(bool_or(one), false) AS stride_one FROM d GROUP BY 1, 2), k AS (SELECT *, regexp_matches(param, '(?i)^(page|p|pg|pn|pageindex|page_?num(?:ber)?)$') AS known FROM g),
x AS (SELECT *, CASE WHEN stride_one THEN 0 WHEN distinct_values >= 2 THEN 1 WHEN known THEN 2 ELSE 3 END AS strength FROM k)
SELECT root, param, distinct_values, stride_one, rank FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY strength, known DESC, param) AS rank FROM x) WHERE strength < 3
"""


def input_urls(spark, folder):
    """Start addresses from rows of inputs, with an empty value on some."""
    brand = F.when(F.col("p_partkey") % 7 == 0, F.lit(" ")).otherwise(F.col("p_brand"))
    rows = table(spark, folder, "part").select("p_partkey", brand.alias("brand"), "p_name")
    made = P.input_urls(rows, "https://shop.example.com/s?b={brand}&q={p_name}", "p_partkey")
    return made.select("p_partkey", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("error", F.lit("")).alias("error"))


INPUT_URLS = """
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE 'https://shop.example.com/s?b=' || replace(p_brand, '#', '%23') || '&q=' || replace(p_name, ' ', '%20') END AS url,
  CASE WHEN p_partkey % 7 = 0 THEN 'no value for brand' ELSE '' END AS error FROM part
"""


def request_words(spark, folder):
    """Scores of addresses by their words alone, those of a recorded response added to every path."""
    from skein.operators import ranking as R

    words = U.url_words(F.regexp_replace("url", r"^([^?#]*)", "$1/api/productDetail/related"))
    score = hits(words, R.PRODUCT_URL_WORDS) * WEIGHTS["product_word"] + hits(words, R.API_URL_WORDS) * WEIGHTS["api_word"] + hits(words, R.RELATION_URL_WORDS) * WEIGHTS["relation_word"]
    return table(spark, folder, "pages").select("page_id", score.cast("long").alias("score"))


_LISTS = {name: "[" + ", ".join(f"'{w}'" for w in words) + "]" for name, words in (("product", PRODUCT_URL_WORDS), ("api", API_URL_WORDS), ("relation", RELATION_URL_WORDS))}
REQUEST_WORDS = _PARTS + rf"""
, w AS (SELECT page_id, list_distinct(list_filter(string_split_regex(lower(regexp_replace(path || '/api/productDetail/related', '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM s)
SELECT page_id, CAST(4 * len(list_intersect(w, {_LISTS["product"]})) + 2 * len(list_intersect(w, {_LISTS["api"]})) - 30 * len(list_intersect(w, {_LISTS["relation"]})) AS BIGINT) AS score FROM w
"""


def request_scores(spark, folder):
    """Scores of pages as recorded responses: words of the path, keys (those words, and three more on three pages in four)
    and size."""
    pages = table(spark, folder, "pages").select("page_id", "url", F.length("html").alias("size"))
    keys = F.when(F.col("page_id") % 4 != 0, F.array_union(U.url_words(F.col("url")), F.array(F.lit("price"), F.lit("sku"), F.lit("modules")))).otherwise(F.array(F.lit("price")))
    return pages.select("page_id", request_score(F.col("url"), keys, F.col("size")).cast("long").alias("score"))


_MORE = {name: "[" + ", ".join(f"'{w}'" for w in words) + "]" for name, words in (("negative", NEGATIVE_URL_WORDS), ("keys", PRODUCT_KEYS), ("config", CONFIG_KEYS))}
REQUEST_SCORES = _PARTS + rf"""
, w AS (SELECT page_id, length(html) AS size, list_distinct(list_filter(string_split_regex(lower(regexp_replace(path, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM s),
k AS (SELECT *, list_distinct(list_concat(w, ['price', 'sku', 'modules'])) AS keys FROM w)
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 0 ELSE CAST(-30 * len(list_intersect(w, {_LISTS["relation"]})) - 10 * len(list_intersect(w, {_MORE["negative"]})) + 4 * len(list_intersect(w, {_LISTS["product"]})) + 2 * len(list_intersect(w, {_LISTS["api"]}))
  + 2 * len(list_intersect(keys, {_MORE["keys"]})) - 4 * len(list_intersect(keys, {_MORE["config"]}))
  + CASE WHEN size > 2000 AND size < 50000 THEN 3 WHEN size > 500 AND size < 100000 THEN 2 WHEN size > 100000 THEN -2 ELSE 0 END AS BIGINT) END AS score FROM k
"""


def ranked_requests(spark, folder):
    """A domain's recorded responses by what their addresses, keys and sizes tell: ten at most, trackers and thin bodies out."""
    n = F.col("page_id")
    more = F.concat(F.when(n % 3 == 0, ',"modules":[{"Layout":1}]').otherwise(""), F.when(n % 5 == 0, ',"name":null').otherwise(""))
    pad = F.concat(F.lit('"pad":"'), F.repeat(F.lit("x"), F.length("html")), F.lit('"'))
    body = F.when(n % 4 == 0, F.concat(F.lit("{"), pad, F.lit("}"))).otherwise(F.concat(F.lit('{"price":1,"item":{"sku":"s"},'), pad, more, F.lit("}")))
    url = F.when(n % 7 == 0, F.lit("https://cdn.onetrust.com/product")).when(n % 11 == 0, F.concat(U.without_fragment(F.regexp_replace("url", r"\?.*$", "")), F.lit("/api/products"))).otherwise(F.col("url"))
    requests = table(spark, folder, "pages").select(U.root_domain(U.host(F.col("url"))).alias("root"), n.alias("seq"), url.alias("url"), body.alias("body"))
    return rank_requests(requests, ["root"]).select("root", "seq", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


RANKED_REQUESTS = _PARTS + rf"""
, q AS (SELECT array_to_string(labels[-2:], '.') AS root, page_id, length(html) AS chars, CASE WHEN page_id % 11 = 0 THEN path || '/api/products' ELSE path END AS path FROM s WHERE page_id % 7 <> 0 AND page_id % 4 <> 0),
w AS (SELECT root, page_id, length('{{"price":1,"item":{{"sku":"s"}},"pad":""}}') + chars + CASE WHEN page_id % 3 = 0 THEN length(',"modules":[{{"Layout":1}}]') ELSE 0 END + CASE WHEN page_id % 5 = 0 THEN length(',"name":null') ELSE 0 END AS size,
  list_distinct(list_filter(string_split_regex(lower(regexp_replace(path, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM q),
k AS (SELECT root, page_id AS seq, CAST(-30 * len(list_intersect(w, {_LISTS["relation"]})) - 10 * len(list_intersect(w, {_MORE["negative"]})) + 4 * len(list_intersect(w, {_LISTS["product"]})) + 2 * len(list_intersect(w, {_LISTS["api"]}))
  + 4 + CASE WHEN page_id % 5 = 0 THEN 2 ELSE 0 END - CASE WHEN page_id % 3 = 0 THEN 8 ELSE 0 END + CASE WHEN size > 2000 AND size < 50000 THEN 3 WHEN size > 500 AND size < 100000 THEN 2 WHEN size > 100000 THEN -2 ELSE 0 END AS BIGINT) AS score FROM w)
SELECT root, seq, score, row_number() OVER (PARTITION BY root ORDER BY score DESC, seq) AS rank FROM k WHERE score > 0 QUALIFY rank <= 10
"""


def analysis_sources_query(spark, folder):
    """Five sources of each host to look at: inline pages first, then the largest."""
    pages = table(spark, folder, "pages").select(U.bare_host(F.col("url")).alias("host"), F.col("page_id").alias("seq"), F.length("html").alias("size"), (F.col("page_id") % 4 == 0).alias("is_inline"))
    return analysis_sources(pages, ["host"]).select("host", "seq", F.col("size").cast("long").alias("size"), F.col("rank").cast("long").alias("rank"))


ANALYSIS_SOURCES = _PARTS + """
SELECT bare AS host, page_id AS seq, CAST(length(html) AS BIGINT) AS size, row_number() OVER (PARTITION BY bare ORDER BY page_id % 4 = 0 DESC, length(html) DESC, page_id) AS rank FROM s QUALIFY rank <= 5
"""


def dense_windows(spark, folder):
    """The stretch of 1,000 characters of each page with the most links."""
    pages = table(spark, folder, "pages").select("page_id", F.split("html", "<a ").alias("parts"))
    from pyspark.sql import Window as W

    # a link stands behind all parts before it and the links between them
    pieces = pages.select("page_id", F.posexplode(F.transform("parts", F.length)).alias("n", "chars"))
    upto = W.partitionBy("page_id").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    points = pieces.withColumn("at", F.sum("chars").over(upto) + 3 * (F.col("n") - 1)).where("n > 0").select("page_id", F.col("at").cast("long").alias("at"))
    return dense_window(points, ["page_id"], "at", 1000)


DENSE_WINDOWS = """
WITH p AS (SELECT page_id, string_split(html, '<a ') AS parts FROM pages), x AS (SELECT page_id, unnest(list_transform(range(1, len(parts)), lambda i: length(array_to_string(parts[1:i], '<a ')))) AS pos FROM p),
w AS (SELECT page_id, pos, count(*) OVER (PARTITION BY page_id ORDER BY pos RANGE BETWEEN CURRENT ROW AND 1000 FOLLOWING) AS n FROM x)
SELECT page_id, arg_max(pos, n * 1000000000 - pos) AS start, max(n) AS points FROM w GROUP BY 1
"""


def page_nodes(spark, folder):
    """Elements of each page by the reader, counted by tag."""
    found = H.nodes(table(spark, folder, "pages").select("page_id", "html"), "page_id", "html")
    return found.groupBy("page_id", "tag").agg(F.count("*").alias("elements"))


PAGE_NODES = r"""
WITH t AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '<!--(?s:.*?)-->', '', 'g'), '(?is)(<script[^>]*>).*?</script>', '\1', 'g'), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages)
SELECT page_id, tag, count(*) AS elements FROM t GROUP BY 1, 2
"""


def xpath_probe(spark, folder):
    """What three paths read on every page."""
    found = H.nodes(table(spark, folder, "pages").select("page_id", "html"), "page_id", "html")
    probed = H.probe_xpaths(found, "page_id", ["//nav/ul/li[2]/a/@href", '//div[@class="ad"]', "/html/head/meta/@charset"])
    return probed.select("page_id", "xpath", "matches", F.when(F.col("xpath").startswith("//div"), F.md5("value")).otherwise(F.col("value")).alias("value"))


XPATH_PROBE = r"""
WITH m AS (SELECT page_id, html, regexp_extract_all(regexp_extract(html, '(?s)<nav><ul>(.*?)</ul>', 1), '<a href="([^"]*)"', 1) AS l, regexp_extract_all(html, '(?s)<div class="ad">(.*?)</div>', 1) AS d FROM pages)
SELECT page_id, '//nav/ul/li[2]/a/@href' AS xpath, CAST(1 AS BIGINT) AS matches, replace(l[2], '&amp;', '&') AS value FROM m WHERE len(l) >= 2
UNION ALL SELECT page_id, '//div[@class="ad"]', CAST(len(d) AS BIGINT), md5(nullif(trim(regexp_replace(replace(d[1], '&amp;', '&'), '[\s\x{00A0}]+', ' ', 'g')), '')) FROM m WHERE len(d) > 0
UNION ALL SELECT page_id, '/html/head/meta/@charset', CAST(1 AS BIGINT), 'utf-8' FROM m
"""


def listing_rows(spark, folder):
    """Entries of each page's navigation as rows of a list: address, label and a field that no entry has."""
    found = H.nodes(table(spark, folder, "pages").select("page_id", "html"), "page_id", "html")
    rows = H.extract_rows(found, "page_id", "//nav/ul/li", {"href": "./a/@href", "label": ".//a", "price": "./span"})
    return rows.select("page_id", F.col("item").cast("long").alias("item"), "href", "label", F.coalesce("price", F.lit("")).alias("price"))


LISTING_ROWS = r"""
WITH l AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<nav><ul>(.*?)</ul>', 1), '(?s)<li>(.*?)</li>', 1) AS l FROM pages),
i AS (SELECT page_id, unnest(l) AS li, unnest(range(len(l))) AS item FROM l)
SELECT page_id, item, replace(regexp_extract(li, '<a href="([^"]*)"', 1), '&amp;', '&') AS href, trim(replace(regexp_extract(li, '<a [^>]*>(.*?)</a>', 1), '&amp;', '&')) AS label, '' AS price FROM i
"""


def schema_drift(spark, folder):
    """Changes of a fresh extraction against the store: line states as fields, line numbers as their paths."""
    paths = table(spark, folder, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("field"), F.col("l_linenumber").alias("path")).agg(
        F.count_if(F.col("l_discount") > 0.07).alias("hits"), F.count_if(F.col("l_discount") <= 0.07).alias("misses")
    )
    fresh = spark.createDataFrame([("AF", False), ("NO", True), ("XX", True)], "field string, found boolean")
    return contract.schema_changes(paths, fresh)


SCHEMA_DRIFT = """
WITH p AS (SELECT l_returnflag || l_linestatus AS field, l_linenumber AS path, count(*) FILTER (l_discount > 0.07) AS hits, count(*) FILTER (l_discount <= 0.07) AS misses FROM lineitem GROUP BY 1, 2),
s AS (SELECT field, sum(hits + misses) AS uses, bool_and(hits + misses > 10 AND hits / (hits + misses) < 0.5) AS weak FROM p GROUP BY 1), f AS (FROM (VALUES ('AF', false), ('NO', true), ('XX', true)) v(field, found)),
c AS (SELECT coalesce(s.field, f.field) AS field, CASE WHEN uses IS NULL THEN 'field_added' WHEN found IS NULL THEN CASE WHEN uses > 5 THEN 'field_removed' END WHEN weak AND NOT found THEN 'field_degraded' END AS change FROM s FULL JOIN f ON s.field = f.field)
SELECT * FROM c WHERE change IS NOT NULL
"""


QUERIES = {
    "url_keys": (url_keys, URL_KEYS),
    "variant_pairs": (variant_pairs, VARIANT_PAIRS),
    "page_text": (page_text, PAGE_TEXT),
    "page_verdicts": (page_verdicts, PAGE_VERDICTS),
    "links": (links, LINKS),
    "detail_links": (detail_links, DETAIL_LINKS),
    "work_list": (work_list, WORK_LIST),
    "outlinks": (outlinks, OUTLINKS),
    "shape_groups": (shape_groups, SHAPE_GROUPS),
    "merged_shapes": (merged_shapes, MERGED_SHAPES),
    "page_parameters": (page_parameters, PAGE_PARAMETERS),
    "input_urls": (input_urls, INPUT_URLS),
    "request_words": (request_words, REQUEST_WORDS),
    "request_scores": (request_scores, REQUEST_SCORES),
    "ranked_requests": (ranked_requests, RANKED_REQUESTS),
    "analysis_sources": (analysis_sources_query, ANALYSIS_SOURCES),
    "dense_windows": (dense_windows, DENSE_WINDOWS),
    "page_nodes": (page_nodes, PAGE_NODES),
    "xpath_probe": (xpath_probe, XPATH_PROBE),
    "listing_rows": (listing_rows, LISTING_ROWS),
    "schema_drift": (schema_drift, SCHEMA_DRIFT),
}
