"""Ranking, caps and samples. Every order ends in a total tie-break."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.json_leaves import key_set
from skein.functions.names import name_words, same_words
from skein.functions.urls import is_third_party_noise, url_words

# Authority of a path's source, and the order of certified sources.
SOURCE_AUTHORITY = {"human": 100, "verified": 90, "json-ld": 80, "meta": 70, "xpath": 60, "xpath-cached": 55, "api": 40, "api-ai": 30, "ai-vision": 20, "ai-discovered-variants": 20}
CERTIFIED_ORDER = {"api": 0, "json-ld": 1, "meta": 2, "xpath": 3}
MOST_PATHS, PER_SOURCE = 5, 2


def lookup(column: Column, values: dict[str, int], default: int) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), F.lit(default))


def path_score(now: Column) -> Column:
    """Hit rate of a path; misses weigh fully within two weeks of the last use and half after it (or if never used);
    the confidence stands for an untried path."""
    total = F.col("hits") + F.col("misses")
    recent = F.coalesce(F.unix_seconds(now) - F.unix_seconds("last_used_at") < 14 * 86_400, F.lit(False))
    weighted = F.col("hits") + F.col("misses") * F.when(recent, 1.0).otherwise(0.5)
    return F.when(total == 0, F.col("confidence")).when(F.col("misses") == 0, F.lit(1.0)).otherwise(F.col("hits") / weighted)


def _flag(column: str) -> Column:
    return F.coalesce(F.col(column).cast("boolean"), F.lit(False))


def rank_paths(paths: DataFrame, keys: Sequence[str], now: Column) -> DataFrame:
    """Adds score and rank: pinned, then human, then score (to nine digits), then source authority, then place."""
    order = [_flag("pinned").desc(), (F.col("source") == "human").desc(), F.round("score", 9).desc(), lookup(F.col("source"), SOURCE_AUTHORITY, 0).desc(), F.col("place")]
    scored = paths.withColumn("score", path_score(now))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def prune_paths(paths: DataFrame, keys: Sequence[str], now: Column, most: int = MOST_PATHS) -> DataFrame:
    """Protected paths (pinned, human or verified) stay; others go after five uses at a tenth or less, and only as many of the
    best stay as the protected ones leave room for."""
    guarded = _flag("pinned") | F.col("source").isin("human", "verified")
    total = F.col("hits") + F.col("misses")
    alive = guarded | (total < 5) | (F.col("hits") / total > 0.1)
    ranked = rank_paths(paths.where(alive).withColumn("_guarded", guarded), keys, now)
    room = F.sum(F.col("_guarded").cast("int")).over(W.partitionBy(*keys))
    place = F.row_number().over(W.partitionBy(*keys, "_guarded").orderBy("rank"))
    kept = ranked.withColumns({"_room": F.lit(most) - room, "_place": place}).where("_guarded OR _place <= _room")
    return kept.drop("_guarded", "_room", "_place")


def rank_verified(paths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pinned first, then hit rate (untried counts as 1), source order, shorter path."""
    total = F.col("hits") + F.col("misses")
    rate = F.when(total > 0, F.col("hits") / total).otherwise(F.lit(1.0))
    order = [_flag("pinned").desc(), rate.desc(), lookup(F.col("origin"), CERTIFIED_ORDER, 9), F.length("path"), F.col("path")]
    return paths.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def rank_certified(paths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source order, length (a ``[page]`` step counts as an index), ``[page]`` before its numeric twin."""
    length = F.length(F.replace("path", F.lit("[page]"), F.lit("[0]")))
    order = [lookup(F.col("source"), CERTIFIED_ORDER, 9), length, (~F.contains("path", F.lit("[page]"))).cast("int"), F.col("path")]
    return paths.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def spread_sources(ranked: DataFrame, keys: Sequence[str], source: str, per_source: int = PER_SOURCE, most: int = MOST_PATHS) -> DataFrame:
    """Pinned paths first and uncapped, then one of each source, then a second of each, sources in the order of their
    best path; a source's pinned paths use up its turns. The first ``most`` stay, numbered by ``place``."""
    own = W.partitionBy(*keys, source)
    pinned = _flag("pinned")
    held = F.sum(pinned.cast("int")).over(own)
    turn = F.row_number().over(W.partitionBy(*keys, source, "_pinned").orderBy("rank"))
    marked = ranked.withColumns({"_pinned": pinned, "_best": F.min("rank").over(own), "_held": held}).withColumn("_turn", turn)
    round_no = F.when(F.col("_pinned"), 0).otherwise(F.col("_held") + F.col("_turn"))
    fits = marked.withColumn("_round", round_no).where((F.col("_round") <= per_source))
    order = ["_round", F.when(F.col("_pinned"), F.col("rank")).otherwise(F.col("_best")), "rank"]
    placed = fits.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= most)
    return placed.drop("_pinned", "_best", "_held", "_turn", "_round")


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)


def even_sample(pool: DataFrame, keys: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """Of each key's n rows in order, those at floor(i * n / most) for i below ``most``; all if there are fewer."""
    at = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    n = F.count("*").over(W.partitionBy(*keys))
    numbered = pool.withColumns({"_at": at, "_n": n})
    # position p is floor(i*n/most) for some i exactly when i = ceil(p*most/n) lands on it
    i = F.ceil(F.col("_at") * most / F.col("_n"))
    hit = (F.col("_n") <= most) | ((i < most) & (F.floor(i * F.col("_n") / most) == F.col("_at")))
    return numbered.where(hit).drop("_at", "_n")


# Words and keys that tell product responses from others, and what each weighs.
PRODUCT_URL_WORDS = ["product", "products", "item", "items", "listing", "listings", "detail", "details", "pdp", "catalog", "sku", "price", "prices", "search"]
API_URL_WORDS = ["api", "graphql", "v1", "v2", "v3", "rest"]
NEGATIVE_URL_WORDS = [
    "log", "logs", "logger", "logevent", "track", "tracking", "beacon", "telemetry", "metrics", "analytics", "ping", "collect",
    "auth", "session", "token", "login", "consent", "config", "configs", "configuration", "flag", "flags", "feature", "features",
]
RELATION_URL_WORDS = [
    "relation", "relations", "related", "relationinfo", "recommend", "recommends", "recommended", "recommendation", "recommendations",
    "similar", "alsobought", "alsoviewed", "crosssell", "upsell", "bestseller", "bestsellers", "sponsored", "advertising", "ads",
]
PRODUCT_KEYS = [
    "price", "pricing", "title", "name", "productname", "description", "image", "imageurl", "images", "rating", "review", "reviews", "reviewcount",
    "sku", "upc", "gtin", "mpn", "brand", "manufacturer", "model", "availability", "instock", "stock", "category", "seller", "shipping", "currency",
]
CONFIG_KEYS = ["featureflags", "experiments", "modules", "layout", "zones", "components", "template", "templates", "slots", "placeholders"]
WEIGHTS = {"product_word": 4, "api_word": 2, "negative_word": -10, "relation_word": -30, "product_key": 2, "config_key": -4, "sweet": 3, "plausible": 2, "oversized": -2}


def hits(values: Column, among: Sequence[str]) -> Column:
    return F.size(F.array_intersect(values, F.array(*[F.lit(x) for x in among])))


def request_score(url: Column, keys: Column, body_size: Column, weights: dict[str, int] = WEIGHTS) -> Column:
    """Words of the path (the first matching list counts), keys of the body, and its size if it has product keys.
    Bodies with fewer than three keys score 0."""
    by_list = lambda words: (
        hits(words, RELATION_URL_WORDS) * weights["relation_word"]
        + hits(words, NEGATIVE_URL_WORDS) * weights["negative_word"]
        + hits(words, PRODUCT_URL_WORDS) * weights["product_word"]
        + hits(words, API_URL_WORDS) * weights["api_word"]
    )
    # a list of one binds the words, so that they are split once and not once a list of words
    by_words = F.transform(F.array(url_words(url)), by_list)[0]
    product = hits(keys, PRODUCT_KEYS)
    size = (
        F.when(product == 0, 0)
        .when((body_size > 2000) & (body_size < 50_000), weights["sweet"])
        .when((body_size > 500) & (body_size < 100_000), weights["plausible"])
        .when(body_size > 100_000, weights["oversized"])
        .otherwise(0)
    )
    return F.when(F.size(keys) < 3, 0).otherwise(by_words + product * weights["product_key"] + hits(keys, CONFIG_KEYS) * weights["config_key"] + size)


def rank_requests(requests: DataFrame, keys: Sequence[str], most: int = 10) -> DataFrame:
    """JSON responses (columns url, body, seq) most product-like first; noise and scores of 0 or less go."""
    read = requests.where(~is_third_party_noise(F.col("url"))).withColumn("json_keys", key_set(F.col("body")))
    scored = read.withColumn("score", request_score(F.col("url"), F.col("json_keys"), F.octet_length("body"))).where("score > 0")
    return top_per(scored, keys, [F.col("score").desc(), F.col("seq")], most)


def analysis_sources(sources: DataFrame, keys: Sequence[str], most: int = 5) -> DataFrame:
    """Inline data before recorded responses, larger first, in capture order."""
    return top_per(sources, keys, [F.col("is_inline").desc(), F.col("size").desc(), F.col("seq")], most)


def dense_window(points: DataFrame, keys: Sequence[str], at: str, width: int) -> DataFrame:
    """Start of the window [x, x + width] with the most points, the first on a tie, and their number."""
    inside = F.count("*").over(W.partitionBy(*keys).orderBy(at).rangeBetween(0, width))
    counted = points.withColumn("_inside", inside)
    best = F.max_by(F.struct(F.col(at).alias("start"), F.col("_inside").alias("points")), F.struct("_inside", -F.col(at)))
    return counted.groupBy(*keys).agg(best.alias("w")).select(*keys, "w.*")


def cluster_score(gap_share: Column, count: Column, most: Column, coverage: Column) -> Column:
    return 0.55 * gap_share + 0.25 * (count / most) + 0.2 * coverage


def stride_series(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key the number of distinct values and whether two neighbours differ by one."""
    distinct = values.select(*keys, value).distinct()
    step = F.col(value) - F.lag(value).over(W.partitionBy(*keys).orderBy(value))
    stepped = distinct.withColumn("_one", F.coalesce(step == 1, F.lit(False)))
    return stepped.groupBy(*keys).agg(F.count("*").alias("distinct_values"), F.max("_one").alias("stride_one"))


def proof_triple(candidates: DataFrame, name: str, price: str, order: str, most: int = 30) -> DataFrame:
    """Three proof products: of the first ``most`` the lexicographically first triple of different products whose prices
    are not all equal (an unknown price differs from any), else of different products, else the first three. Only the
    top of a listing is looked at, as one array."""
    card = F.struct(F.col(order).alias("o"), name_words(F.col(name)).alias("n"), F.col(price).alias("p"))
    first = candidates.orderBy(order).limit(most).agg(F.array_sort(F.collect_list(card)).alias("a"))

    def triples(x):
        def behind(*chosen):
            return F.filter("a", lambda c: reduce(lambda s, t: s & t, [(c["o"] > k["o"]) & ~same_words(c["n"], k["n"]) for k in chosen]))

        def with_third(y):
            alike = lambda z: F.coalesce((x["p"] == y["p"]) & (y["p"] == z["p"]), F.lit(False))
            return F.transform(behind(x, y), lambda z: F.struct(alike(z).alias("alike"), x["o"].alias("first"), y["o"].alias("second"), z["o"].alias("third")))

        return F.flatten(F.transform(behind(x), with_third))

    place = lambda n: F.try_element_at("a", F.lit(n))["o"]
    plain = F.struct(F.lit(True).alias("alike"), place(1).alias("first"), place(2).alias("second"), place(3).alias("third"))
    best = F.coalesce(F.array_min(F.flatten(F.transform("a", triples))), F.when(F.size("a") >= 3, plain))
    return first.select(best.alias("t")).where("t IS NOT NULL").select("t.first", "t.second", "t.third")
