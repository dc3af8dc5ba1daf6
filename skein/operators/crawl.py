"""Crawling over captured pages: how a page leads to its next one, which links stand on product cards, groups of product
links, and what a walk over listing pages plans before it stops."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions import html as H
from skein.functions import urls as U

from .labels import spread_labels
from .pages import PAGE_PARAMETER, next_link
from .storage import materialise

# How addresses of numbered pages are written, in order of trust.
NUMBERED = [
    r'(?i)href="([^"]*[?&]page=)(\d+)([^"]*)"',
    r'(?i)href="([^"]*[?&]p=)(\d+)([^"]*)"',
    r'(?i)href="([^"]*[?&]offset=)(\d+)([^"]*)"',
    r'(?i)href="([^"]*[?&]start=)(\d+)([^"]*)"',
    r'(?i)href="([^"]*/page/)(\d+)(/[^"]*)"',
]
# Buttons that lead to the next page with the selector of each, and words of galleries that have such too.
NEXT_BUTTONS = [
    (r"(?i)<a\b[^>]*rel=[\"']next[\"']", 'a[rel="next"]'),
    (r"(?i)aria-label=[\"']Next page[\"']", '[aria-label="Next page"]'),
    (r"(?i)aria-label=[\"']Next[\"']", '[aria-label="Next"]'),
    (r"(?is)class=[\"'][^\"']*\bnext\b[^\"']*[\"'][^>]*>.*?(Next|→|›|»)", ".next a, a.next, .next button, button.next"),
    (r"(?i)<(?:a|button)[^>]*>(?:\s*(?:<[^>]+>\s*)*)?Next(?:\s*(?:<[^>]+>\s*)*)?</(?:a|button)>", 'a:has-text("Next"), button:has-text("Next")'),
]
GALLERY = r"(?i)(swiper|slide|slider|carousel|gallery|thumb|banner|marquee)"
# Elements that hold the numbers of pages.
NUMBER_BARS = [
    r"(?is)(<nav[^>]*aria-label=[\"'][^\"']*paginat[^\"']*[\"'][^>]*>.*?</nav>)",
    r"(?is)(<[^>]+class=[\"'][^\"']*pagination[^\"']*[\"'][^>]*>.*?</\w+>)",
    r"(?is)(<[^>]+role=[\"']navigation[\"'][^>]*>.*?</\w+>)",
]
NEAR = 200


def resolved(href: Column, base: Column) -> Column:
    """``href`` on a page at ``base`` without leaving the JVM: steps up (``../``) are left as they are written."""
    origin = F.concat(F.lower(U.part(base, "PROTOCOL")), F.lit("://"), U.host(base))
    folder = F.concat(origin, F.regexp_replace(F.coalesce(F.nullif(U.path(base), F.lit("")), F.lit("/")), "[^/]*$", ""))
    return (
        F.when(href.rlike("(?i)^https?://"), href)
        .when(href.startswith("//"), F.concat(F.lower(U.part(base, "PROTOCOL")), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(origin, U.path(base), href))
        .otherwise(F.concat(folder, href))
    )


def _cursor(candidates: Column, pairs: Column) -> Column:
    """Of the parameters that moved, the one whose values on the page's own links go in steps of one, then one that
    varies there, then a usual name, then the first."""

    def judged(name: Column, place: Column) -> Column:
        own = F.filter(pairs, lambda p: (p["key"] == name) & p["value"].rlike(r"^\d+$"))
        seen = F.array_sort(F.array_distinct(F.transform(own, lambda p: p["value"].try_cast("long"))))
        steps = F.zip_with(F.slice(seen, 2, F.greatest(F.size(seen), F.lit(1))), seen, lambda behind, before: behind - before)
        strength = F.when(F.exists(steps, lambda s: s == 1), 0).when(F.size(seen) >= 2, 1).otherwise(2)
        return F.struct(strength.alias("strength"), (~name.rlike(PAGE_PARAMETER)).alias("unusual"), place.alias("place"), name.alias("name"))

    return F.array_min(F.transform(candidates, judged))["name"]


def pagination(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """How a page leads on: strategy (url-pattern, next-button, page-numbers or null), template (address with ``{N}``,
    or the next address where no number moved), selector. In order: the declared next page, addresses of numbered
    pages, a next button that stands in no gallery, a bar of page numbers. One pass over the pages, no shuffle."""
    url, html = F.col("_url"), F.col("_html")
    read = pages.select(id_col, F.col(url_col).alias("_url"), F.coalesce(html_col, F.lit("")).alias("_html"))
    declared = read.withColumn("_next", resolved(next_link(html), url))
    here = U.query_pairs(url)
    moved = F.filter(U.query_pairs(F.col("_next")), lambda p: p["value"].rlike(r"^\d+$") & ~F.exists(here, lambda h: (h["key"] == p["key"]) & (h["value"] == p["value"])))
    hrefs = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)href=[\"']([^\"']+)[\"']"), F.lit(1)), lambda h: resolved(H.decode_entities(h), url))
    same = U.response_key(F.col("_next")) == U.response_key(url)
    series = F.flatten(F.transform(F.filter(hrefs, lambda h: U.response_key(h) == U.response_key(url)), U.query_pairs))
    led = declared.withColumn("_moved", F.when(same, F.array_distinct(F.transform(moved, lambda p: p["key"])))).withColumn(
        "_pairs", F.when(F.size("_moved") > 1, series).otherwise(F.array().cast("array<struct<key: string, value: string>>"))
    )
    cursor = led.withColumn("_cursor", _cursor(F.col("_moved"), F.col("_pairs")))
    mark = F.concat(F.lit(r"([?&]\Q"), F.col("_cursor"), F.lit(r"\E=)\d+"))
    templated = F.coalesce(F.regexp_replace("_next", mark, F.lit("$1{N}")), F.col("_next"))

    def found(strategy: str, template: Column | None, selector: Column | None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(F.lit(strategy).alias("strategy"), (none if template is None else template).alias("template"), (none if selector is None else selector).alias("selector"))

    choices = [F.when(F.col("_next").isNotNull(), found("url-pattern", templated, None))]
    for pattern in NUMBERED:
        higher = F.exists(F.regexp_extract_all(html, F.lit(pattern), F.lit(2)), lambda n: n.try_cast("double") > 1)
        first = F.concat(F.regexp_extract(html, pattern, 1), F.lit("{N}"), F.regexp_extract(html, pattern, 3))
        choices.append(F.when(higher, found("url-pattern", resolved(first, url), None)))
    for pattern, selector in NEXT_BUTTONS:
        at = F.regexp_instr(html, F.lit(pattern))
        start = F.greatest(at - NEAR, F.lit(1))
        around = F.substring(html, start, at - start + NEAR)
        choices.append(F.when((at > 0) & ~around.rlike(GALLERY), found("next-button", None, F.lit(selector))))
    for pattern in NUMBER_BARS:
        bar = F.regexp_extract(html, pattern, 1)
        label = F.regexp_extract(bar, r"aria-label=[\"']([^\"']+)[\"']", 1)
        name = F.regexp_extract(bar, r"class=[\"']([^\"'\s]+)[^\"']*[\"']", 1)
        selector = F.when(label != "", F.concat(F.lit('[aria-label="'), label, F.lit('"] a'))).when(name != "", F.concat(F.lit("."), name, F.lit(" a"))).otherwise("nav a")
        choices.append(F.when(F.regexp_count(bar, F.lit(r"<a[^>]+>\s*\d+\s*</a>")) >= 2, found("page-numbers", None, selector)))
    return cursor.select(id_col, F.coalesce(*choices).alias("p")).select(id_col, "p.strategy", "p.template", "p.selector")


#: A card is a link or one of its next six ancestors with at most three product keys, under 800 characters and an image.
CARD_UP, CARD_LINKS, CARD_TEXT, IMAGE_CARDS = 6, 3, 800, 6
# Signs and codes of currencies beside an amount.
SIGN = r"(?:[$€£¥₹₩₽₺₪฿₫₱]|(?<![A-Za-z])(?:USD|EUR|GBP|JPY|CNY|INR|AUD|CAD|NZD|CHF|SEK|NOK|DKK|PLN|CZK|HUF|MYR|SGD|HKD|AED|SAR|ZAR|BRL|MXN|TRY|RM|Rs\.?|kr|zł|Kč|Ft|lei)(?![A-Za-z]))"
AMOUNT = r"(?:\d{1,3}(?:[.,\s']\d{3})+(?:[.,]\d{1,2})?|\d+(?:[.,]\d{1,2})?)"
PRICE = rf"{SIGN}\s?{AMOUNT}|{AMOUNT}\s?{SIGN}"
# Roles of a page's frame and of option pickers.
FRAME_ROLES = r"(?i)\b(navigation|banner|contentinfo|complementary)\b"
PICKER_ROLES = r"(?i)^(radio|radiogroup)$"


def _upward(most: int | None = None) -> Column:
    """The element's own path and those of its ancestors below the body, nearest first."""
    steps = F.split("xpath", "/")
    size = F.size(steps)
    paths = F.transform(F.sequence(size, F.lit(2), F.lit(-1)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    below = F.filter(paths, lambda p: ~p.rlike(r"/(?:body|html)\[\d+\]$"))
    return below if most is None else F.slice(below, 1, most)


def card_links(node_table: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """Links of pages (the node table with the page's address beside each node): id, pos, url, text, key, shape, carded (on
    a card with a price), imaged (on a card), chrome (in the page's frame), swatch (an option of another product).

    An element's links, images and text are added up per ancestor; only elements that are small enough to be a card
    have their text put together and searched for a price."""
    href = F.col("attrs")["href"]
    url = F.when((F.col("tag") == "a") & href.isNotNull() & ~href.rlike(r"^(#|\w+:(?!//))"), U.without_fragment(resolved(href, F.col(url_col))))
    role, css = F.coalesce(F.col("attrs")["role"], F.lit("")), F.coalesce(F.col("attrs")["class"], F.lit(""))
    text = F.when(~F.col("tag").isin("script", "style", "noscript", "title"), H.own_text(F.col("text")))
    marked = node_table.select(
        id_col, "pos", "xpath", url.alias("url"), U.product_key(url).alias("key"), text.alias("text"), F.col("tag").isin("img", "picture").alias("image"),
        role.rlike(FRAME_ROLES).alias("frame"),
        (role.rlike(PICKER_ROLES) | css.rlike("(?i)swatch") | F.map_contains_key("attrs", "data-swatch") | F.map_contains_key("attrs", "aria-checked")).alias("picker"),
    )
    told = materialise(marked.where("url IS NOT NULL OR text IS NOT NULL OR image OR frame OR picker"), "marks")
    held = told.withColumn("element", F.explode(_upward())).select(id_col, "element", "pos", "key", "text", "image")
    sizes = held.groupBy(id_col, "element").agg(F.count_distinct("key").alias("keys"), F.max("image").alias("image"), F.coalesce(F.sum(F.length("text") + 1), F.lit(0)).alias("chars"))
    cards = sizes.where((F.col("keys") <= CARD_LINKS) & (F.col("chars") < CARD_TEXT) & F.col("image")).select(id_col, "element")
    texts = held.join(cards, [id_col, "element"]).groupBy(id_col, "element").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), " ").alias("shown"))
    priced = texts.select(id_col, "element", F.col("shown").rlike(PRICE).alias("price"))
    links = told.where("url IS NOT NULL")
    levels = links.select(id_col, "pos", F.explode(_upward(CARD_UP + 1)).alias("element"))
    on = levels.join(priced, [id_col, "element"]).groupBy(id_col, "pos").agg(F.max("price").alias("carded"), F.lit(True).alias("imaged"))
    signs = told.where("frame OR picker").select(id_col, F.col("xpath").alias("element"), "frame", "picker")
    within = links.select(id_col, "pos", F.explode(_upward()).alias("element")).join(signs, [id_col, "element"]).groupBy(id_col, "pos").agg(F.max("frame").alias("frame"), F.max("picker").alias("picker"))
    named = told.where("text IS NOT NULL").select(id_col, F.explode(_upward()).alias("xpath"), F.col("pos").alias("at"), "text").join(links.select(id_col, "xpath", "pos"), [id_col, "xpath"])
    words = named.groupBy(id_col, "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ").alias("label"))
    no = lambda c: F.coalesce(c, F.lit(False))
    outer = F.regexp_extract("xpath", r"^(.*)/(?:header|footer)\[\d+\]", 1)
    edge = F.col("xpath").rlike(r"/(header|footer)\[") & ~outer.rlike(r"/(article|section|main|aside|nav)\[")
    label = F.coalesce("label", F.lit(""))
    joined = links.drop("text", "frame", "picker", "image").join(on, [id_col, "pos"], "left").join(within, [id_col, "pos"], "left").join(words, [id_col, "pos"], "left")
    return joined.select(
        id_col, "pos", "url", label.alias("text"), "key", U.url_shape(F.col("url")).alias("shape"), no(F.col("carded")).alias("carded"), no(F.col("imaged")).alias("imaged"),
        (no(F.col("frame")) | edge | F.col("xpath").rlike(r"/(nav|aside)\[")).alias("chrome"),
        (label.rlike(r"(?i)^(\+\s?\d+|\s*option\s*:.*)$") | (no(F.col("picker")) & ~no(F.col("carded")))).alias("swatch"),
    )


def card_groups(links: DataFrame, page: str, shapes: int = 3, keys: int = 2) -> DataFrame:
    """The group of product links of each page, from ``card_links``: (page, how, shape, members, carded, first). Shapes that
    differ in one literal segment are one group where ``shapes`` of them have ``keys`` carded products each; most carded
    products win, then most links. Links with a price outside the frame come first, then all links, then images alone
    where six products or more have one (how: priced, framed, imaged)."""
    usable = links.where("key IS NOT NULL AND NOT swatch")
    tiers = F.array(
        F.struct(F.lit("priced").alias("how"), F.lit(1).alias("tier"), F.col("carded").alias("on"), (~F.col("chrome")).alias("looked")),
        F.struct(F.lit("framed").alias("how"), F.lit(2).alias("tier"), F.col("carded").alias("on"), F.lit(True).alias("looked")),
        F.struct(F.lit("imaged").alias("how"), F.lit(3).alias("tier"), F.col("imaged").alias("on"), (~F.col("chrome")).alias("looked")),
    )
    seen = usable.select(page, "pos", "shape", "key", F.explode(tiers).alias("t")).where("t.looked").select(page, F.col("t.tier").alias("tier"), F.col("t.how").alias("how"), "shape", "key", "pos", F.col("t.on").alias("on"))
    once = materialise(seen.groupBy(page, "tier", "how", "shape", "key").agg(F.min("pos").alias("pos"), F.max("on").alias("on")), "cards")
    by_shape = once.groupBy(page, "tier", "shape").agg(F.count_if("on").alias("carded")).withColumn("node", F.to_json(F.struct(F.col(page).cast("string"), "tier", "shape")))
    parts = F.split("shape", "/")
    hole = lambda i: F.array_join(F.transform(parts, lambda s, j: F.when(i == j, F.lit("*")).otherwise(s)), "/")
    literal = F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: (F.try_element_at(parts, i + 1) != "") & ~F.try_element_at(parts, i + 1).startswith("*"))
    holes = by_shape.where("carded > 0").select(page, "tier", "node", "carded", F.explode(F.transform(literal, hole)).alias("hole"))
    kept = holes.where(F.exists(F.slice(F.split("hole", "/"), 2, 10_000), lambda s: (s != "") & ~F.contains(s, F.lit("*"))))
    merging = kept.groupBy(page, "tier", "hole").agg(F.count_if(F.col("carded") >= keys).alias("n"), F.min("node").alias("root")).where(F.col("n") >= shapes).select(page, "tier", "hole", "root")
    own = by_shape.select(page, "tier", F.col("shape").alias("hole"), "node")
    edges = kept.select(page, "tier", "hole", "node").unionByName(own).join(merging, [page, "tier", "hole"]).select(F.col("node").alias("leaf"), "root")
    labels = spread_labels(edges).withColumnRenamed("label", "group")
    grouped = by_shape.join(labels, "node", "left").select(page, "tier", "shape", F.coalesce("group", "node").alias("group"))
    members = once.join(grouped, [page, "tier", "shape"]).groupBy(page, "tier", "how", "group", "key").agg(F.min("pos").alias("pos"), F.max("on").alias("on"), F.collect_set("shape").alias("shapes"))
    totals = members.groupBy(page, "tier", "how", "group").agg(
        F.count("*").alias("members"), F.count_if("on").alias("carded"), F.min("pos").alias("first"), F.array_distinct(F.flatten(F.collect_set("shapes"))).alias("shapes")
    )
    enough = totals.where((F.col("carded") >= F.when(F.col("tier") == 3, IMAGE_CARDS).otherwise(1)))
    best = F.max_by(F.struct("how", "group", "shapes", "members", "carded", "first"), F.struct(-F.col("tier"), "carded", "members", -F.col("first")))
    chosen = enough.groupBy(page).agg(best.alias("b")).select(page, "b.*")
    split = F.transform("shapes", lambda s: F.split(s, "/"))
    common = F.transform(F.element_at(split, 1), lambda s, i: F.when(F.forall(split, lambda x: F.try_element_at(x, i + 1) == s), s).otherwise("*"))
    return chosen.select(page, "how", F.array_join(common, "/").alias("shape"), "members", "carded", "first")


def with_item_list(groups: DataFrame, items: DataFrame, page: str, least: int = 3) -> DataFrame:
    """Groups beside the products that a page lists as data (page, key): a list of ``least`` products or more that shares
    none with a smaller group takes its place. ``groups`` has (page, carded), ``items`` (page, key, in_group)."""
    listed = items.groupBy(page).agg(F.count_distinct("key").alias("listed"), F.max("in_group").alias("shared")).where(F.col("listed") >= least)
    joined = groups.join(listed, page, "full")
    data = F.col("listed").isNotNull() & ~F.coalesce("shared", F.lit(False)) & (F.col("carded").isNull() | (F.col("listed") > F.col("carded")))
    return joined.select(page, F.when(data, "data").otherwise(F.col("how")).alias("how"), F.when(~data, F.col("shape")).alias("shape"), F.when(data, F.col("listed")).otherwise(F.col("carded")).alias("carded"))


def walk(rows: DataFrame, cap: int, share: float = 0.25, most_pages: int | None = None, looks: int = 4) -> tuple[DataFrame, DataFrame]:
    """What a crawl plans from captured listing pages: rows (run, input, page, pos, url; a page without links is one row
    with a null url; links at one place in the order of their addresses), inputs in their order, each address once a run, at most ``cap`` an input from its first
    ``most_pages`` pages (null: all).

    Returns the planned rows, and per input: items, page_one, gained (behind page one), stop (budget, empty-page,
    all-duplicates or null), stop_page, thin (the pages behind the first, with room left, gave less than ``share`` of
    it), certifies (the way to the next page brought something and is not thin, so it may be kept for later runs). A
    page that stops an input hides the pages behind it, and their addresses stay free for later inputs. So the inputs'
    plans are read together again until no address changes hands; runs that still change after ``looks`` readings are
    folded in order, so the number of readings has a bound whatever the number of inputs. With no looks all runs are
    folded in order, and read together once."""
    looked = rows.select("run", "input", "page", "pos", "url")
    if not looks:
        looked = looked.repartition("run")
    if most_pages is not None:
        nth = F.dense_rank().over(W.partitionBy("run", "input").orderBy("page"))
        looked = looked.withColumn("nth", nth).where(F.col("nth") <= most_pages).drop("nth")
    first = F.row_number().over(W.partitionBy("run", "input", "url").orderBy("page", "pos"))
    own = looked.withColumn("own", F.col("url").isNotNull() & (first == 1))
    judged = _look(_in_order(own, cap), cap) if not looks else _looked_again(materialise(own, "walk"), cap, looks)
    items = judged.where("planned").select("run", "input", "page", "pos", "url", "place")
    told = judged.groupBy("run", "input").agg(
        F.count_if("planned").alias("items"), F.count_if(F.col("planned") & (F.col("page") == F.col("one"))).alias("page_one"), F.min(F.when(F.col("stop").isNotNull(), F.struct("page", "stop"))).alias("s")
    )
    told = told.select("run", "input", "items", "page_one", F.col("s.stop").alias("stop"), F.col("s.page").alias("stop_page"))
    gained = F.col("items") - F.col("page_one")
    room = ~F.col("stop").eqNullSafe(F.lit("budget"))
    thin = room & (F.col("page_one") > 0) & (gained < share * F.col("page_one"))
    return items, told.withColumns({"gained": gained, "thin": thin, "certifies": (gained > 0) & ~thin})


def _looked_again(own: DataFrame, cap: int, looks: int) -> DataFrame:
    """All inputs judged, read together until no address changes hands, then runs that still change folded in order. Runs and
    addresses meet by shuffles: their stored form is much smaller than their rows, so that sizes of files tell too little."""
    taken = changed = None
    for _ in range(looks):
        judged = _look(_given(own, taken), cap)
        now = materialise(judged.where("planned").groupBy("run", "url").agg(F.min("input").alias("owner")), "taken")
        changed = None
        if taken is not None:
            moved = now.join(taken.withColumnRenamed("owner", "was").hint("merge"), ["run", "url"], "full").where(~F.col("owner").eqNullSafe(F.col("was")))
            changed = materialise(moved.select("run").distinct(), "moved")
        taken = now
        if changed is not None and changed.isEmpty():
            return judged
    restless, quiet = own, None
    if changed is not None:
        restless, quiet = own.join(changed.hint("merge"), "run", "left_semi"), own.join(changed.hint("merge"), "run", "left_anti")
    marked = _in_order(restless.repartition("run"), cap)
    return _look(marked if quiet is None else marked.unionByName(_given(quiet, taken)), cap)


def _in_order(own: DataFrame, cap: int) -> DataFrame:
    """(run, input, page, pos, url, fresh) by walking each run's inputs one after another: fresh addresses are those that no
    input before has planned. ``own`` is laid out by run, which is one task; its rows arrive sorted, in batches, and the fold
    keeps the addresses that the run has planned."""
    columns = ["run", "input", "page", "pos", "url"]
    schema = own.select(*columns, F.col("own").alias("fresh")).schema

    def folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = listing = page = object()
        planned: set = set()
        count = new = 0
        ended = False
        for rows in batches:
            found = []
            for r, i, p, url, mine in zip(*[rows.column(c).to_pylist() for c in ("run", "input", "page", "url", "own")]):
                if r != run:
                    planned, run, listing = set(), r, object()
                if i != listing:
                    listing, page, count, new, ended = i, p, 0, 0, False
                elif p != page:
                    ended = ended or new == 0 or count >= cap
                    page, new = p, 0
                fresh = mine and url not in planned
                found.append(fresh)
                if ended or not fresh:
                    continue
                count, new = count + 1, new + 1
                if count <= cap:
                    planned.add(url)
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in columns], pa.array(found, pa.bool_())], [*columns, "fresh"])

    return own.sortWithinPartitions("run", "input", "page", "pos", "url").mapInArrow(folds, schema)


# Pages and items of a plan without a budget, pages of one that asks for all, and items of any plan.
PLAN_PAGES, PLAN_ITEMS, ALL_PAGES, MOST_ITEMS = 3, 50, 10, 5000


def budget(raw: Column) -> Column:
    """struct<pages, items> that a plan may take by its budget, a JSON object: positive whole numbers (not as text), or
    "all"; anything else is the default."""
    told = F.try_parse_json(raw)

    def part(name: str, default: int) -> Column:
        value = F.try_variant_get(told, f"$.{name}", "variant")
        number = F.when(F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(told, f"$.{name}", "double"))
        return F.when((number > 0) & (number == F.floor(number)), F.least(number, F.lit(2.0**31 - 1)).cast("int")).otherwise(default)

    is_all = lambda name: F.coalesce(F.try_variant_get(told, f"$.{name}", "string") == "all", F.lit(False))
    pages = F.when(is_all("max_pages"), ALL_PAGES).otherwise(part("max_pages", PLAN_PAGES))
    items = F.when(is_all("max_items") | is_all("mode"), MOST_ITEMS).otherwise(part("max_items", PLAN_ITEMS))
    return F.struct(pages.alias("pages"), F.least(items, F.lit(MOST_ITEMS)).alias("items"))


def plan_direct(inputs: DataFrame) -> DataFrame:
    """Plans without listing pages: rows (run, input, url, cap), a null url for an input that gave no address. Each
    address is planned once a run, by its first input, until the run's ``cap`` is reached. Adds status (planned,
    skipped_budget, error) and items (1 for the input that holds the address, else 0: a repeated one is planned)."""
    named = inputs.where("url IS NOT NULL").groupBy("run", "url").agg(F.min("input").alias("owner"), F.min("cap").alias("cap"))
    place = F.row_number().over(W.partitionBy("run").orderBy("owner", "url"))
    held = named.withColumn("place", place).where((F.col("place") <= MOST_ITEMS) & (F.col("place") <= F.col("cap"))).select("run", "url", "owner")
    joined = inputs.join(held, ["run", "url"], "left")
    status = F.when(F.col("url").isNull(), "error").when(F.col("owner").isNull(), "skipped_budget").otherwise("planned")
    items = F.coalesce(F.col("owner") == F.col("input"), F.lit(False)).cast("int")
    return joined.select("run", "input", "url", status.alias("status"), items.alias("items"))


def _given(own: DataFrame, taken: DataFrame | None) -> DataFrame:
    """Rows with fresh, given which input holds each address."""
    held = own.withColumn("owner", F.lit(None)) if taken is None else own.join(taken.hint("merge"), ["run", "url"], "left")
    fresh = F.col("own") & (F.col("owner").isNull() | (F.col("owner") >= F.col("input")))
    return held.select("run", "input", "page", "pos", "url", fresh.alias("fresh"))


def _look(marked: DataFrame, cap: int) -> DataFrame:
    """One look at all inputs, given which of their rows are fresh: adds place, stop (what stops the input on the row's page),
    one (the input's first page) and planned. All windows lie in the tasks of their inputs."""
    own = W.partitionBy("run", "input")
    upto = own.orderBy("page", "pos", "url").rowsBetween(W.unboundedPreceding, 0)
    placed = marked.withColumn("place", F.sum(F.col("fresh").cast("long")).over(upto))
    on = W.partitionBy("run", "input", "page")
    new, sum_, any_ = F.count_if("fresh").over(on), F.max("place").over(on), F.max(F.col("url").isNotNull()).over(on)
    stop = F.when((F.col("_new") > 0) & (F.col("_sum") >= cap), "budget").when((F.col("_new") == 0) & F.col("_any"), "all-duplicates").when(F.col("_new") == 0, "empty-page")
    judged = placed.withColumns({"_new": new, "_sum": sum_, "_any": any_}).withColumn("stop", stop).drop("_new", "_sum", "_any")
    ended = judged.withColumns({"_end": F.min(F.when(F.col("stop").isNotNull(), F.col("page"))).over(own), "one": F.min("page").over(own)})
    planned = F.col("fresh") & (F.col("place") <= cap) & (F.col("_end").isNull() | (F.col("page") <= F.col("_end")))
    return ended.withColumn("planned", planned).drop("_end")
