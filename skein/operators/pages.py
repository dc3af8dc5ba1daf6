"""Page-level operators: verdicts, links, pagination, product groups, hints."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import html as H
from skein.functions import urls as U

SUBSTANTIAL, BLANK = 1000, 100

# What walls, denials and missing pages say.
CHALLENGE_WORDS = ["just a moment", "checking your browser", "verify you are human", "confirm you are human", "confirm that you're human", "are you a robot", "not a robot", "press & hold", "press and hold", "quick verification", "human verification"]
CHALLENGE_MARKERS = ["px-captcha", "captcha.awswaf.com", "captcha-delivery.com"]
DENIED_WORDS = ["access denied", "you have been blocked", "your request has been blocked", "this request was blocked", "restricted access"]
ERROR_TITLES = ["403 forbidden", "401 unauthorized", "404 not found", "429 too many requests", "503 service unavailable", "502 bad gateway"]
MISSING_TITLES = ["not found", "page not found", "doesn't exist", "no longer available"]


def _any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def wall_vendor(html: Column, server: Column) -> Column:
    low, by = F.lower(html), F.lower(F.coalesce(server, F.lit("")))
    return (
        F.when(F.contains(low, F.lit("awswaf")), "aws-waf")
        .when((by == "cloudflare") | _any(low, ["cloudflare", "ray id"]), "cloudflare")
        .when(F.contains(by, F.lit("akamai")) | F.contains(low, F.lit("akamaighost")), "akamai")
        .when(_any(low, ["px-captcha", "_pxhd", "_pxvid", "perimeterx"]), "perimeterx")
        .when(F.contains(low, F.lit("datadome")), "datadome")
    )


def page_signs(pages: DataFrame, html: str, title: str) -> DataFrame:
    """What the verdict looks at, each read from the page once: _head, _start and _top (lower-case title and first
    characters), _text (lower-case visible text), _marker (a vendor's challenge markup)."""
    low = F.lower(F.coalesce(html, F.lit("")))
    return pages.withColumns(
        {
            "_head": F.lower(F.coalesce(title, F.lit(""))),
            "_start": F.substring(low, 1, 2000),
            "_top": F.substring(low, 1, 10_000),
            "_text": F.lower(H.visible_text(F.coalesce(html, F.lit("")))),
            "_marker": _any(low, CHALLENGE_MARKERS),
        }
    )


def wall_kind() -> Column:
    """challenge, refused or null, from ``page_signs``. Only thin pages are walls, by what they say or a vendor's
    challenge markup."""
    said = F.concat_ws("\n", "_head", "_text")
    challenge = said.rlike(r"\bcaptcha\b") | F.col("_marker") | said.rlike("|".join(re.escape(w) for w in CHALLENGE_WORDS))
    return F.when(F.length("_text") >= SUBSTANTIAL, F.lit(None).cast("string")).when(challenge, "challenge").when(_any(said, DENIED_WORDS), "refused")


def page_health() -> Column:
    """ok, an error page's code, soft-404 or blank, from ``page_signs``; the first rule that holds."""
    head, top = F.col("_head"), F.col("_top")
    code = F.regexp_extract(F.concat_ws("\n", "_head", "_start"), "(" + "|".join(ERROR_TITLES) + ")", 1)
    named = head.rlike(r"\b404\b") & (head.rlike("not found|error") | (F.length("_text") < SUBSTANTIAL))
    sorry = _any(head, ["sorry", "page not found", "couldn't find"]) & _any(top, ["try searching", "go to", "home page"])
    oops = _any(head, ["oops", "something went wrong", "error"]) & _any(top, ["try again", "go back", "home page"])
    return (
        F.when(code != "", F.substring(code, 1, 3))
        .when(named | sorry | _any(head, MISSING_TITLES) | oops, "soft-404")
        .when(F.length("_text") < BLANK, "blank")
        .otherwise("ok")
    )


def with_verdict(pages: DataFrame, html: str, title: str, status: str, requested: str, final: str) -> DataFrame:
    """Adds verdict: challenge, refused, not-found, redirected, blank or ok."""
    signs = page_signs(pages, html, title)
    judged = signs.withColumns({"_wall": wall_kind(), "_health": page_health()})
    moved = U.root_domain(U.host(F.col(requested))) != U.root_domain(U.host(F.col(final)))
    answer, wall, health = F.col(status), F.col("_wall"), F.col("_health")
    verdict = (
        F.when((wall == "challenge") & answer.isin(401, 403), "refused")
        .when(wall.isNotNull(), wall)
        .when(answer.isin(404, 410), "not-found")
        .when(answer >= 400, "refused")
        .when(F.coalesce(moved, F.lit(False)), "redirected")
        .when(health.isin("404", "soft-404"), "not-found")
        .when(health != "ok", "blank")
        .otherwise("ok")
    )
    return judged.withColumn("verdict", verdict).drop("_head", "_start", "_top", "_text", "_marker", "_wall", "_health")


def link_table(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """One row per anchor: id, pos, href, text, url (absolute where the page's own origin suffices, else null)."""
    rows = pages.select(id_col, F.col(url_col).alias("_page"), F.posexplode(H.links(F.col(html_col))).alias("pos", "a"))
    href = F.col("a.href")
    origin = F.concat(F.lower(U.part(F.col("_page"), "PROTOCOL")), F.lit("://"), U.host(F.col("_page")))
    url = F.when(href.startswith("/") & ~href.startswith("//"), F.concat(origin, href)).when(href.rlike("(?i)^https?://"), href)
    return rows.select(id_col, "_page", "pos", href.alias("href"), F.col("a.text").alias("text"), U.without_fragment(url).alias("url"))


def detail_links(links: DataFrame, run: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Addresses of a run, each once at its first place; links of a page to itself and other schemes go."""
    real = links.where(F.col("url").isNotNull() & (F.col("url") != U.without_fragment(F.col("_page"))))
    first = F.row_number().over(W.partitionBy(*run, "url").orderBy(*order))
    return real.withColumn("_n", first).where("_n = 1").drop("_n")


def next_link(html: Column) -> Column:
    tag = F.regexp_extract(html, r"(?i)<link\b[^>]*rel=[\"']next[\"'][^>]*>", 0)
    return F.nullif(H.decode_entities(F.regexp_extract(tag, r"(?i)href=[\"']([^\"']+)[\"']", 1)), F.lit(""))


PAGE_PARAMETER = r"(?i)^(page|p|pg|pn|pageindex|page_?num(?:ber)?)$"


def page_parameters(links: DataFrame, page: Sequence[str]) -> DataFrame:
    """Numeric parameters of a page's links and how they vary: param, values, stride_one, known, rank. A parameter that
    moves in steps of one ranks first, then any that varies, then a usual name."""
    from .ranking import stride_series

    pairs = links.select(*page, F.explode(U.query_pairs(F.col("url"))).alias("p")).select(*page, F.col("p.key").alias("param"), F.col("p.value").try_cast("long").alias("value"))
    series = stride_series(pairs.where("value IS NOT NULL"), [*page, "param"], "value").withColumn("known", F.col("param").rlike(PAGE_PARAMETER))
    strength = F.when(F.col("stride_one"), 0).when(F.col("distinct_values") >= 2, 1).when(F.col("known"), 2).otherwise(3)
    order = [strength, F.col("known").desc(), F.col("param")]
    return series.withColumn("strength", strength).withColumn("rank", F.row_number().over(W.partitionBy(*page).orderBy(*order))).where("strength < 3")


def product_groups(links: DataFrame, page: Sequence[str], least: int = 3) -> DataFrame:
    """Link shapes of a page with at least ``least`` product keys: shape, keys, first place, rank (most keys first)."""
    keyed = links.select(*page, "pos", U.url_shape(F.col("url")).alias("shape"), U.product_key(F.col("url")).alias("key")).where("key IS NOT NULL")
    once = keyed.groupBy(*page, "shape", "key").agg(F.min("pos").alias("pos"))
    groups = once.groupBy(*page, "shape").agg(F.count("*").alias("keys"), F.min("pos").alias("first")).where(F.col("keys") >= least)
    return groups.withColumn("rank", F.row_number().over(W.partitionBy(*page).orderBy(F.col("keys").desc(), "first")))


def merged_shapes(groups: DataFrame, page: Sequence[str], shapes: int = 3, keys: int = 2) -> DataFrame:
    """Shapes that differ in one path segment merge where at least ``shapes`` of them have ``keys`` products each: the
    differing segment becomes ``*``. Every shape is exploded into its forms with one hole, and holes are grouped."""
    parts = F.split("shape", "/")
    holes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.transform(parts, lambda s, j: F.when(i == j, F.lit("*")).otherwise(s)), "/"))
    holed = groups.where(F.size(parts) > 1).select(*page, "shape", F.col("keys"), F.explode(holes).alias("merged"))
    found = holed.groupBy(*page, "merged").agg(F.count_if(F.col("keys") >= keys).alias("shapes"), F.sum("keys").alias("keys"))
    return found.where(F.col("shapes") >= shapes)


def listing_hint(rows: Column, has_pager: Column) -> Column:
    """A listing with two rows or fewer and no pager looks like a detail page."""
    return (rows <= 2) & ~has_pager


def detail_hint(json_ld_type: Column) -> Column:
    return json_ld_type.isin("ItemList", "CollectionPage")


def input_urls(inputs: DataFrame, template: str, order: str) -> DataFrame:
    """Start addresses of input rows: placeholders ``{name}`` take a column's value, percent-encoded. A row with an
    empty placeholder or a result that is no http(s) address becomes an error row; never a guess."""
    names = list(dict.fromkeys(re.findall(r"\{(\w+)\}", template)))
    filled, missing = F.lit(template), []
    for name in names:
        value = F.col(name).cast("string") if name in inputs.columns else F.lit(None).cast("string")
        missing.append(F.when(F.coalesce(F.trim(value), F.lit("")) == "", F.lit(name)))
        encoded = value if template == f"{{{name}}}" else U.percent_encode(value)
        filled = F.replace(filled, F.lit(f"{{{name}}}"), F.coalesce(encoded, F.lit("")))
    lacking = F.array_compact(F.array(*missing).cast("array<string>"))
    error = (
        F.when(F.size(lacking) > 0, F.concat(F.lit("no value for "), F.array_join(lacking, ", ")))
        .when(~filled.rlike(r"(?i)^https?://[^\s/]+"), F.lit("not an http(s) address"))
    )
    return inputs.select(order, F.when(error.isNull(), filled).alias("url"), error.alias("error"))


def planned_items(links: DataFrame, run: Sequence[str], group: str, order: Sequence[str], most: int) -> DataFrame:
    """Work list of a run: addresses once over all inputs, then at most ``most`` per input; later ones are marked
    skipped_budget."""
    first = F.row_number().over(W.partitionBy(*run, "url").orderBy(*order))
    once = links.withColumn("_n", first).where("_n = 1").drop("_n")
    place = F.row_number().over(W.partitionBy(*run, group).orderBy(*order))
    return once.withColumn("place", place).withColumn("status", F.when(F.col("place") <= most, "planned").otherwise("skipped_budget"))


def listing_api(arrays: DataFrame, urls: DataFrame, page: Sequence[str], least: int = 3, share: float = 0.5) -> DataFrame:
    """The recorded array whose identifiers cover the most of a page's addresses: (page, response, array_path,
    matched, covered). ``arrays`` has response, array_path, identifier; ``urls`` has identifier."""
    wanted = urls.select(*page, "identifier").distinct()
    total = wanted.groupBy(*page).agg(F.count("*").alias("total"))
    ids = arrays.select(*page, "response", "array_path", "identifier").distinct()
    sizes = ids.groupBy(*page, "response", "array_path").agg(F.count("*").alias("length"))
    matched = ids.join(wanted, [*page, "identifier"]).groupBy(*page, "response", "array_path").agg(F.count("*").alias("matched"))
    scored = matched.join(sizes, [*page, "response", "array_path"]).join(total, list(page)).withColumn("covered", F.col("matched") / F.col("total"))
    good = scored.where((F.col("matched") >= least) & (F.col("covered") >= share))
    best = F.max_by(F.struct("response", "array_path", "matched", "covered"), F.struct("covered", "length", "array_path"))
    return good.groupBy(*page).agg(best.alias("b")).select(*page, "b.*")
