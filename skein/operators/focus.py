"""The stretch of a long page that holds its repeating content: places of markup, clusters of them, a ladder of signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import cluster_score
from .relational import small

# Attributes by which a page names its results, words of tiles, marks of filters, repeating elements with
# their weights, and what each signal is worth at most.
RESULTS_ATTRIBUTE = (
    r'(?i)(?:id|aria-label|data-test-id|data-testid|data-cy|role)="[^"]*'
    r'(?:search-?results?|results?-(?:list|grid|container|items)|listing-?(?:list|grid|results)|product-?(?:list|grid))[^"]*"'
)
TILE_WORDS = r"(?i)(grid|card|item|product|result|tile|cell|listing|entry|post|hit)"
FILTER_MARKS = [r'(?i)id="[^"]*filter[^"]*"', r'(?i)class="[^"]*(?:facet|filter|refine|sort-by|sortby)[^"]*"', r'(?i)aria-label="[^"]*(?:filter|sort)[^"]*"']
REPEATED = {"article": 0.9, "li": 0.7, "tr": 0.85, "section": 0.7}
CLASSES, LINKS, IMAGES = r'class="([^"]{1,200})"', r'(?i)<a\b[^>]*href="([^"]+)"', r'(?i)<img\b[^>]*src="[^"]+"'
LADDER = ["landmark", "results-attribute", "repeated-class", "link-shape", "semantic-repeat", "link-density", "image-cluster", "filter-nav"]

_PLACES = {"class": CLASSES, "link": LINKS, "image": IMAGES, **{tag: rf"(?i)<{tag}\b" for tag in REPEATED}}


def places(pages: DataFrame, keys: Sequence[str], patterns: dict[str, str] = _PLACES, html: str = "html") -> DataFrame:
    """Matches of each pattern from left to right: keys, kind, n (their order), at (characters before), found.

    A match lies behind all text between matches and all matches before it, so a running sum over the narrow rows of a
    page gives its place; the page itself is read where it lies.
    """
    text = F.col(html)

    def cut(kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.zip_with(F.split(text, pattern), found, lambda p, f: F.struct(F.lit(kind).alias("kind"), F.length(p).cast("long").alias("before"), f.alias("found")))

    cuts = F.filter(F.concat(*[cut(k, p) for k, p in patterns.items()]), lambda c: c["found"].isNotNull())
    rows = pages.select(*keys, F.posexplode(cuts).alias("n", "c")).select(*keys, "n", "c.*").repartition(*keys)
    upto = F.sum(F.col("before") + F.length("found")).over(W.partitionBy(*keys, "kind").orderBy("n"))
    return rows.select(*keys, "kind", "n", (upto - F.length("found")).alias("at"), "found")


def clusters(points: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Per keys, from points (at, n): points in all, first (at, n), start of the first window of ``width`` with the most points, inside
    (points from start to before start + width), gap (their upper median) and score. Gaps count most, so that large tiles
    outweigh long menus."""
    dense = F.count("*").over(W.partitionBy(*keys).orderBy("at").rangeBetween(0, width))
    grouped = points.withColumn("_dense", dense).groupBy(*keys).agg(
        F.count("*").alias("points"),
        F.min(F.struct("at", "n")).alias("first"),
        F.max_by("at", F.struct("_dense", -F.col("at"))).alias("start"),
        F.array_sort(F.collect_list("at")).alias("_all"),
    )
    held = grouped.withColumn("_in", F.filter("_all", lambda p: (p >= F.col("start")) & (p < F.col("start") + width))).withColumn("inside", F.size("_in").cast("long"))
    steps = F.zip_with(F.slice("_in", F.lit(2), F.col("inside").cast("int")), "_in", lambda b, a: b - a)
    gaps = F.array_sort(F.filter(steps, lambda g: g.isNotNull()))
    told = held.withColumn("_gaps", gaps).withColumn("gap", F.coalesce(F.try_element_at("_gaps", (F.floor(F.size("_gaps") / 2) + 1).cast("int")), F.lit(0)))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("gap") - 300) / 2700))
    span = F.element_at("_in", -1) - F.element_at("_in", 1)
    score = cluster_score(share, F.least(F.col("inside"), F.lit(12)), F.lit(12), F.least(F.lit(1.0), span / width))
    return told.select(*keys, "points", "first", "start", "inside", "gap", score.alias("score"))


def link_form(href: Column) -> Column:
    """Path of an address with digits as # and runs of 12 or more letters and digits as *; inner ``..`` steps stay."""
    local = F.regexp_replace(F.regexp_replace(href, r"^(?i)(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*", "/"), r"[?#].*$", "")
    rooted = F.when(local.rlike(r"^(?i)[a-z][a-z0-9+.-]*:"), F.regexp_replace(local, r"^[^:]*:", "")).otherwise(F.concat(F.lit("/"), F.regexp_replace(local, r"^(?:/|\.{1,2}(?:/|$))+", "")))
    return F.regexp_replace(F.regexp_replace(rooted, r"\d+", "#"), r"(?i)[a-z0-9]{12,}", "*")


def _repeats(found: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Signals of repeated places: keys, ladder, raw, turn (which of equals is asked first), index, confidence, detail."""
    kind = F.col("kind")
    classes = F.filter(F.split(F.regexp_extract("found", CLASSES, 1), r"\s+"), lambda c: F.length(c).between(3, 40))
    form = link_form(F.regexp_extract("found", LINKS, 1))
    group = lambda ladder, token: F.struct(F.lit(LADDER.index(ladder)).alias("ladder"), token.alias("token"))
    groups = (
        F.when(kind == "class", F.transform(classes, lambda c: group("repeated-class", c)))
        .when(kind == "link", F.filter(F.array(group("link-density", F.lit("")), group("link-shape", form)), lambda g: (g["token"] == "") | (F.length(g["token"]) >= 2)))
        .when(kind == "image", F.array(group("image-cluster", F.lit(""))))
        .otherwise(F.array(group("semantic-repeat", kind)))
    )
    points = found.select(*keys, "at", F.posexplode(groups).alias("n", "g")).select(*keys, "g.ladder", "g.token", "at", "n")
    told = clusters(points, [*keys, "ladder", "token"], width)
    is_of = lambda ladder: F.col("ladder") == LADDER.index(ladder)
    weight, turn = F.lit(1.0), F.lit(0)
    for n, (tag, share) in enumerate(REPEATED.items()):
        weight, turn = F.when(F.col("token") == tag, share).otherwise(weight), F.when(F.col("token") == tag, n).otherwise(turn)
    weighed = F.col("score") * weight
    raw = F.when(is_of("repeated-class"), F.col("score") + F.when(F.col("token").rlike(TILE_WORDS), 0.05).otherwise(0.0)).when(is_of("semantic-repeat"), weighed).otherwise(F.col("score"))
    least = F.when(is_of("link-density"), 10).when(is_of("image-cluster"), 8).otherwise(5)
    worth = (
        F.when(is_of("repeated-class"), F.least(F.lit(0.9), raw))
        .when(is_of("link-shape"), F.least(F.lit(0.88), raw))
        .when(is_of("link-density"), F.least(F.lit(0.75), 0.3 + F.col("inside") / 120))
        .when(is_of("image-cluster"), F.least(F.lit(0.6), 0.25 + F.col("inside") / 100))
        .otherwise(raw)
    )
    # of equal clusters the one met first on the page stands; elements are asked in their own order
    asked = F.when(is_of("semantic-repeat"), F.struct(turn.cast("long").alias("at"), F.lit(0).alias("n"))).otherwise(F.col("first"))
    return told.where(F.col("inside") >= least).select(*keys, "ladder", raw.alias("raw"), asked.alias("turn"), F.col("start").alias("index"), worth.alias("confidence"))


def _last(text: Column, pattern: Column) -> Column:
    """Characters before the last match; the pattern matches."""
    return F.length(text) - F.length(F.element_at(F.split(text, pattern), -1)) - F.length(F.element_at(F.regexp_extract_all(text, pattern, F.lit(0)), -1))


def _landmark(text: Column, landmark: Column) -> tuple[Column, Column]:
    """Index and worth of a text that stands above the results: whole (its last place), else the first run of four, three
    or two of its words that the page shows with marks between them."""
    mark = F.trim(landmark)
    at = F.length(text) - F.length(F.split_part(text, mark, F.lit(-1))) - F.length(mark)
    exact = F.contains(text, mark)
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(mark), r"[^a-z0-9]+", " ")), " "), lambda w: F.length(w) > 2)

    def runs(words: Column) -> Column:
        sizes = F.filter(F.array(F.lit(4), F.lit(3), F.lit(2)), lambda s: s <= F.size(words))
        of = lambda s: F.transform(F.sequence(F.lit(1), F.size(words) - s + 1), lambda i: F.concat(F.lit("(?i)"), F.array_join(F.slice(words, i, s), "[^a-z0-9]{1,80}")))
        return F.flatten(F.transform(sizes, of))

    shown = F.filter(F.transform(F.array(words), runs)[0], lambda p: F.regexp_like(text, p))
    some = F.try_element_at(shown, F.lit(1))
    usable = F.length(mark) >= 3
    index = F.when(usable & exact, at).when(usable & some.isNotNull(), _last(text, some))
    once = F.instr(text, mark) - 1 == at
    return index, F.when(exact, F.when(once, 0.95).otherwise(0.6)).otherwise(0.91)


def _marks(pages: DataFrame, keys: Sequence[str], html: str, landmark: Column | None) -> DataFrame:
    """Signals of single places: a landmark, the last attribute that names the results, the last kind of filter."""
    text = F.col(html)
    named = F.when(F.regexp_like(text, F.lit(RESULTS_ATTRIBUTE)), _last(text, F.lit(RESULTS_ATTRIBUTE)))
    filters = F.greatest(*[F.regexp_instr(text, F.lit(m)) for m in FILTER_MARKS]) - 1
    signals = [("results-attribute", named, F.lit(0.92)), ("filter-nav", F.when(filters >= 0, filters), F.lit(0.45))]
    if landmark is not None:
        signals.append(("landmark", *_landmark(text, landmark)))
    rows = [F.struct(F.lit(LADDER.index(s)).alias("ladder"), i.cast("long").alias("index"), c.alias("confidence")) for s, i, c in signals]
    return pages.select(*keys, F.explode(F.array(*rows)).alias("s")).select(*keys, "s.*").where("index IS NOT NULL")


def focus_points(pages: DataFrame, keys: Sequence[str], most: int, html: str = "html", landmark: str | None = None) -> DataFrame:
    """keys, strategy, index: where to start reading each page of which ``most`` characters are to be read.

    A page that fits is read whole; a longer one from a little before its surest signal (ties: the higher rung of the
    ladder), or from its head without one. Null pages are empty; ``keys`` are those of a page; positions count code points.
    """
    own = pages.select(*keys, F.coalesce(F.col(html), F.lit("")).alias("html"), *([F.col(landmark).alias("landmark")] if landmark else []))
    long = own.where(F.length("html") > most)
    best = F.min_by(F.struct("index", "confidence"), F.struct(-F.col("raw"), "turn"))
    repeats = _repeats(places(long, keys), keys, most).groupBy(*keys, "ladder").agg(best.alias("b")).select(*keys, "ladder", "b.*")
    marks = _marks(long, keys, "html", F.col("landmark") if landmark else None)
    surest = F.min_by(F.struct("ladder", "index"), F.struct(-F.col("confidence"), "ladder"))
    won = repeats.unionByName(marks).groupBy(*keys).agg(surest.alias("w"))
    lead = min(2000, most // 20)
    # of an array of literals, element_at counts as never null, even at a null index
    named = F.try_element_at(F.array(*[F.lit(s) for s in LADDER]), F.col("w.ladder") + 1)
    told = own.select(*keys, (F.length("html") > most).alias("_long")).join(small(won), list(keys), "left")
    strategy = F.when(~F.col("_long"), "whole-document").otherwise(F.coalesce(named, F.lit("head-of-document")))
    return told.select(*keys, strategy.alias("strategy"), F.coalesce(F.greatest(F.lit(0), F.col("w.index") - lead), F.lit(0)).cast("long").alias("index"))


def focus_windows(pages: DataFrame, keys: Sequence[str], most: int, html: str = "html", landmark: str | None = None) -> DataFrame:
    """``focus_points`` with the text to read: from the first tag at or behind index, at most ``most`` characters, to the
    end of their last tag."""
    points = focus_points(pages, keys, most, html, landmark)
    joined = pages.select(*keys, F.coalesce(F.col(html), F.lit("")).alias("_html")).join(small(points), list(keys))
    tag = F.position(F.lit("<"), F.col("_html"), (F.col("index") + 1).cast("int")).cast("long")
    begin = F.when((F.col("index") == 0) | (tag == 0), F.col("index") + 1).otherwise(tag)
    piece = joined.withColumn("_piece", F.substr(F.col("_html"), begin.cast("int"), F.lit(most)))
    head = F.length("_piece") - F.when(F.contains(F.col("_piece"), F.lit(">")), F.length(F.substring_index("_piece", ">", -1))).otherwise(F.length("_piece"))
    whole = (F.col("strategy") == "whole-document") | (F.length("_piece") < most) | (head <= 1)
    return piece.select(*keys, "strategy", "index", F.when(whole, F.col("_piece")).otherwise(F.substr(F.col("_piece"), F.lit(1), head)).alias("text"))
