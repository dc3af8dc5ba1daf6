"""Variants as links: the place on a set of proof pages that holds exactly the links a customer confirmed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import urls as U
from skein.functions.html import NODES

from .storage import materialise

# Classes that lay out rather than name, how far above the links a place may be named, and how many names a page gives.
LAYOUT_CLASS = "^(is-|has-|js-|d-|flex|grid|col|row|mt-|mb-|p-|px-|py-)"
LEVELS, NAMES_A_PAGE = 4, 12
# Two-letter codes of languages, which may stand before a section in a path.
LANGUAGES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bh bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy"
    " ga gd gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv"
    " mg mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg si sk sl sm sn so sq sr ss st su sv sw"
    " ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
)


def likely_variant(page: Column, link: Column) -> Column:
    """A link to a variant stays on the page's host and, where the page lies in a section, in that section: the first
    segment of the path, or the first two if the first is a language and the page lies deeper. Addresses without a host
    never qualify."""
    return _in_section(_section(page), link)


def _segments(url: Column) -> Column:
    return F.filter(F.split(F.lower(U.path(url)), "/"), lambda s: s != "")


def _section(page: Column) -> Column:
    """Where links to a page's variants stay: struct<authority, path>, the segments of the section."""
    own = _segments(page)
    first = F.try_element_at(own, F.lit(1))
    spoken = first.rlike("^[a-z]{2}([-_][a-z]{2,4})?$") & F.left(first, F.lit(2)).isin(LANGUAGES.split())
    section = F.when(F.size(own) < 2, 0).when((F.size(own) >= 3) & spoken, 2).otherwise(1)
    return F.struct(F.lower(U.part(page, "AUTHORITY")).alias("authority"), F.slice(own, F.lit(1), section).alias("path"))


def _in_section(section: Column, link: Column) -> Column:
    same_path = (F.size(section["path"]) == 0) | (F.slice(_segments(link), F.lit(1), F.greatest(F.size(section["path"]), F.lit(1))) == section["path"])
    return F.coalesce((section["authority"] == F.lower(U.part(link, "AUTHORITY"))) & same_path, F.lit(False))


def _above(xpath: Column, most: int | None = None) -> Column:
    """The paths of an element's ancestors, nearest first, itself excluded."""
    steps = F.split(xpath, "/")
    last = F.lit(2) if most is None else F.greatest(F.lit(2), F.size(steps) - most)
    return F.when(F.size(steps) > 2, F.transform(F.sequence(F.size(steps) - 1, last, F.lit(-1)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))


def _names(attrs: Column) -> Column:
    """How an element can be named in a path: by its id, by each class that is no layout, by its label."""
    quotable = lambda x: x.isNotNull() & (x != "") & ~F.contains(x, F.lit("'"))
    tokens = F.filter(F.split(F.trim(F.coalesce(attrs["class"], F.lit(""))), r"\s+"), lambda t: quotable(t) & ~t.rlike(LAYOUT_CLASS))
    by = lambda attribute, before, after: F.when(quotable(attrs[attribute]), F.concat(F.lit(before), attrs[attribute], F.lit(after)))
    classes = F.transform(tokens, lambda t: F.concat(F.lit("//*[contains(concat(' ', normalize-space(@class), ' '), ' "), t, F.lit(" ')]//a/@href")))
    told = F.concat(F.array(by("id", "//*[@id='", "']//a/@href")), classes, F.array(by("aria-label", "//*[@aria-label='", "']//a/@href")))
    return F.array_distinct(F.array_compact(told))


def certify_links(counted: DataFrame, nodes: DataFrame, by: Sequence[str], noun: str = "variants") -> tuple[DataFrame, DataFrame]:
    """Which named place holds the variants' links of a set of proof pages, and what is wrong on each.

    ``counted`` has (by, url, n, count, links, captured): how many variants somebody confirmed on page number ``n`` and
    their addresses; ``nodes`` is the node table of the captured pages (by, url, tag, xpath, attrs), one row a page and
    element. Confirmed links off the page's section count for nothing, but a page that has only such ones
    fails. Names come from the lowest element around a page's confirmed links and three above it, twelve a page at
    most, in page order. The name that reads exactly the confirmed links on most captured pages is chosen (and no link
    on pages without variants), of equals the first.

    Returns (by, collector, fits) and per page (by, url, status, message, found): ok, none, not_captured, failed.
    Null links are none, repeated ones one; pages without any node are read as empty."""
    key = [*by, "url"]
    named = nodes.where((F.col("tag") == "a") | F.map_contains_key("attrs", "id") | F.map_contains_key("attrs", "class") | F.map_contains_key("attrs", "aria-label"))
    read = named.groupBy(*key).agg(F.collect_list(F.struct("tag", "xpath", "attrs", U.absolute(F.trim(F.col("attrs")["href"]), F.col("url")).alias("address"))).alias("nodes"))
    return certify_pages(counted.join(read.hint("merge"), key, "left"), by, noun)


def certify_pages(pages: DataFrame, by: Sequence[str], noun: str = "variants") -> tuple[DataFrame, DataFrame]:
    """``certify_links`` over the rows of ``counted``, each with the ``nodes`` of its page as an array of (tag, xpath,
    attrs, address), or null.

    What a page says is told in its row and stored, counts for the most part: no element and no link moves. Rows then meet
    at what they are certified ``by``, by shuffles, as stored rows are much smaller than those that a broadcast would hold."""
    told = materialise(_page_links(pages, by), "page-links")
    few = told.where("captured").repartition(*by).select(*by, F.inline("candidates"))
    candidates = few.groupBy(*by, "collector").agg(F.min(F.struct("n", "level", "nth")).alias("o"))
    sites = candidates.groupBy(*by).agg(F.collect_list(F.struct("collector", "o")).alias("_names"))
    met = told.drop("candidates").repartition(*by).join(sites.hint("merge"), list(by), "left")
    # what a name reads on a page: nothing where the page has no link below it
    pages = met.select(*by, "url", "n", "count", "captured", "wanted", "reads", "_names")
    tried = pages.where("captured").select(*by, "n", "count", "wanted", "reads", F.inline("_names"))
    tried = tried.select(*by, "collector", "o", "count", "wanted", _of("reads", F.col("collector")).alias("r")).withColumns({"found": F.coalesce("r.found", F.lit(0)), "matched": F.coalesce("r.matched", F.lit(0))})
    scored = tried.withColumn("fits", _fits()).groupBy(*by, "collector").agg(F.count_if("fits").alias("fits"), F.min("o").alias("o"))
    best = F.max_by(F.struct("collector", "fits"), F.struct("fits", -F.col("o.n"), -F.col("o.level"), -F.col("o.nth")))
    chosen = scored.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")

    some = pages.withColumn("some", F.max(F.col("count") > 0).over(W.partitionBy(*by)))
    told = some.join(chosen.drop("fits").hint("merge"), list(by), "left").withColumn("r", _of("reads", F.col("collector")))
    told = told.withColumns({"found": F.coalesce("r.found", F.lit(0)), "matched": F.coalesce("r.matched", F.lit(0))})
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    message = (
        F.when(_fits(), F.lit(None).cast("string"))
        .when(F.col("count") == 0, said("product ", F.col("n"), " lists ", F.col("found"), f" {noun} — confirm them"))
        .when((F.col("wanted") == 0) | (F.col("found") == 0), said(f"found no {noun} on product ", F.col("n")))
        .when(F.col("found") > F.col("wanted"), said("found ", F.col("found"), f" {noun} on product ", F.col("n"), ", expected ", F.col("wanted")))
        .otherwise(said("found ", F.col("matched"), " of ", F.col("wanted"), f" {noun} on product ", F.col("n")))
    )
    checked = F.col("captured") & F.col("some")
    status = F.when(~F.col("captured"), "not_captured").when(~F.col("some"), "none").when(message.isNotNull(), "failed").when(F.col("count") == 0, "none").otherwise("ok")
    return chosen, told.select(*by, "url", status.alias("status"), F.when(checked, message).alias("message"), F.when(checked, F.col("found")).alias("found"))


def _of(reads: str, collector: Column) -> Column:
    """The entry of ``reads`` of a name, null without one."""
    return F.get(F.filter(reads, lambda r: r["collector"] == collector), F.lit(0))


def _page_links(pages: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per page: by, url, n, count, captured, wanted (confirmed links of its section), candidates (collector, n, level, nth: names
    around its confirmed links, in order), reads (collector, found, matched: links that each name on the page reads, and
    how many of them are confirmed)."""
    none = F.array().cast(NODES)
    given = pages.select(*by, "url", "n", "count", "captured", "links", F.coalesce("nodes", none).alias("nodes"), _section(F.col("url")).alias("section"))
    linked = given.withColumn("linked", F.filter("nodes", lambda e: (e["tag"] == "a") & e["attrs"]["href"].isNotNull()))
    addressed = linked.withColumn("hrefs", U.http_urls(F.transform("linked", lambda e: e["attrs"]["href"]), F.transform("linked", lambda e: e["address"])))
    within = lambda href: _in_section(F.col("section"), href)
    confirmed = F.array_distinct(F.filter(F.zip_with(U.http_urls(F.col("links")), "links", lambda x, own: F.coalesce(x, F.trim(own))), within))
    bears = F.filter("nodes", lambda e: reduce(lambda x, y: x | y, [e["attrs"][c].isNotNull() for c in ("id", "class", "aria-label")]))
    named = F.filter(F.transform(bears, lambda e: F.struct(e["xpath"].alias("xpath"), _names(e["attrs"]).alias("names"))), lambda e: F.size(e["names"]) > 0)
    anchors = F.filter(F.zip_with("linked", "hrefs", lambda e, href: F.struct(e["xpath"].alias("xpath"), href.alias("href"))), lambda a: within(a["href"]))
    read = addressed.select(*by, "url", "n", "count", "captured", F.coalesce(confirmed, F.array().cast("array<string>")).alias("confirmed"), named.alias("named"), anchors.alias("anchors"))

    # the lowest element around all confirmed links: what the first and the last of their paths share
    steps = F.transform(F.filter("anchors", lambda a: F.array_contains(F.col("confirmed"), a["href"])), lambda a: F.split(a["xpath"], "/"))
    ends = read.withColumns({"low": F.array_min(steps), "high": F.array_max(steps)})
    differ = F.array_min(F.filter(F.sequence(F.lit(1), F.size("low")), lambda i: ~F.try_element_at("low", i).eqNullSafe(F.try_element_at("high", i))))
    at = F.array_join(F.slice("low", F.lit(1), F.coalesce(differ - 1, F.size("low"))), "/")
    around = ends.withColumn("at", F.when(F.col("captured") & (F.col("count") > 0) & F.col("low").isNotNull(), at))
    levels = around.withColumn("levels", F.when(F.col("at").isNotNull(), F.concat(F.array("at"), _above(F.col("at"), LEVELS - 1))))
    of = lambda path: F.filter("named", lambda e: e["xpath"] == path)
    name = lambda collector, level, nth: F.struct(collector.alias("collector"), F.col("n").alias("n"), level.alias("level"), nth.alias("nth"))
    ordered = F.flatten(F.transform("levels", lambda path, level: F.flatten(F.transform(of(path), lambda e: F.transform(e["names"], lambda c, nth: name(c, level, nth))))))
    listed = levels.withColumn("ordered", ordered).withColumn("names", F.transform("ordered", lambda o: o["collector"]))
    first = F.filter("ordered", lambda o, i: F.array_position("names", o["collector"]) == i + 1)

    # what each name reads: links below an element that bears it
    bearing = F.transform("anchors", lambda a: F.struct(a["href"].alias("href"), F.flatten(F.transform(F.filter("named", lambda e: F.startswith(a["xpath"], F.concat(e["xpath"], F.lit("/")))), lambda e: e["names"])).alias("names")))
    below = listed.select(*by, "url", "n", "count", "captured", "confirmed", F.slice(first, 1, NAMES_A_PAGE).alias("candidates"), bearing.alias("bearing"))
    below = below.withColumn("names", F.array_distinct(F.flatten(F.transform("bearing", lambda b: b["names"]))))
    hrefs = F.transform("names", lambda c: F.struct(c.alias("collector"), F.array_distinct(F.transform(F.filter("bearing", lambda b: F.array_contains(b["names"], c)), lambda b: b["href"])).alias("hrefs")))
    counts = F.transform(hrefs, lambda h: F.struct(h["collector"].alias("collector"), F.size(h["hrefs"]).alias("found"), F.size(F.array_intersect(h["hrefs"], F.col("confirmed"))).alias("matched")))
    return below.select(*by, "url", "n", "count", "captured", F.size("confirmed").alias("wanted"), "candidates", counts.alias("reads"))


def _fits() -> Column:
    exact = (F.col("wanted") > 0) & (F.col("found") == F.col("wanted")) & (F.col("matched") == F.col("wanted"))
    return F.when(F.col("count") == 0, F.col("found") == 0).otherwise(exact)
