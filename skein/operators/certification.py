"""Certification of fields, from what candidate paths read on proof pages to certified paths, cells and verdicts.

One row set for any number of fields: every step is a join, window or aggregate over the fields' keys. The search for a
cover works on sets: a field's pages are numbered, each path carries the numbers of the pages it reads, and five greedy
steps fold over the field's ranked paths. A field may have any number of pages. Steps that several others read are stored, so that typed comparisons are made once. What a path reads on its pages meets once, in the path's row, and
goes from there to the pages: later steps join rows of paths, not of readings.

Inputs, each with the columns of ``keys``:

* ``fields``: kind, concept, default_value (or null).
* ``cells``: url, at (order of the pages), expected (or null), absent, captured.
* ``candidates``: source, path, transform, seq, confirmed, marked.
* ``readings``: source, path, transform, url, raw (transform applied, null for nothing), response (of an API path, or null).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.html import looks_volatile, xpath_contains_value
from skein.functions.names import CONCEPT_PATHS, fits_concept
from skein.functions.shape import TYPES, normalize, values_equal

from .certify import response_groups
from .ranking import MOST_PATHS, rank_certified, spread_sources
from .storage import materialise

PATH = ("source", "path", "transform")


def by_kind(rows: DataFrame, kinds: Sequence[str], make: Callable[[str], dict[str, Column]]) -> DataFrame:
    """``rows`` with the columns that ``make(kind)`` gives for the kind of the row, each kind in a plan of its own; null for kinds
    that are not among ``kinds``."""
    names = list(make(kinds[0]))
    parts = [rows.where(F.col("kind") == k).withColumns(make(k)) for k in kinds]
    other = rows.where(F.col("kind").isNull() | ~F.col("kind").isin(*kinds))
    return reduce(lambda x, y: x.unionByName(y), [*parts, other.withColumns({n: F.lit(None).cast(parts[0].schema[n].dataType) for n in names})])


def is_fixed_twin(page_path: Column, path: Column) -> Column:
    """``path`` is ``page_path`` with a number for every ``[page]`` step."""
    quoted = F.concat(F.lit(r"^\Q"), F.replace(page_path, F.lit("[page]"), F.lit(r"\E\[\d+\]\Q")), F.lit(r"\E$"))
    return F.contains(page_path, F.lit("[page]")) & F.rlike(path, quoted)


def checked_cells(fields: DataFrame, cells: DataFrame, keys: Sequence[str], kinds: Sequence[str] = TYPES, fold: bool = False) -> DataFrame:
    """The cells that a field is checked on, with its default filled in, the page's number, and what holds for the field: weak,
    weak_evidence, complete, nowhere (absent on every checked page), all_default."""
    default = F.nullif(F.trim("default_value"), F.lit(""))
    met = cells.join(fields, list(keys)).withColumns({"default_value": default, "absent": F.coalesce("absent", F.lit(False))})
    blank = F.trim(F.coalesce("expected", F.lit(""))) == ""
    kept = met.where(F.col("default_value").isNotNull() | ~blank | F.col("absent"))
    filled = kept.withColumn("expected", F.when(~F.col("absent"), F.when(blank, F.col("default_value")).otherwise(F.col("expected"))))

    def forms(kind):
        form = normalize(kind, F.col("expected"), fold=fold)
        equal = values_equal(kind, F.col("expected"), F.col("default_value"), fold=fold)
        return {"_form": F.lower(form) if kind == "text" else form, "_equal": F.when(F.col("default_value").isNotNull(), equal)}

    own = W.partitionBy(*keys)
    typed = by_kind(filled, kinds, forms).withColumn("default_cell", ~F.col("absent") & F.coalesce("_equal", F.lit(False)))
    marked = materialise(typed.drop("_equal"), "cells")
    valued = ~F.col("absent")
    one = (F.size(F.collect_set(F.when(valued, F.col("_form"))).over(own)) == 1) & (F.count(F.when(valued & F.col("_form").isNull(), 1)).over(own) == 0)
    repeated = one & (F.count(F.when(valued, 1)).over(own) > 1)
    captured = F.count(F.when(F.col("captured"), 1)).over(own)
    told = marked.withColumns(
        {
            "page": F.row_number().over(own.orderBy("at", "url")),
            "n_captured": captured,
            "complete": F.min("captured").over(own),
            "weak_evidence": repeated,
            "weak": repeated | (F.col("kind") == "boolean"),
            "nowhere": F.col("default_value").isNull() & F.min("absent").over(own),
            "all_default": F.col("default_value").isNotNull() & F.min(F.col("captured") & F.col("default_cell")).over(own),
        }
    )
    return told.drop("_form")


def fitting_candidates(candidates: DataFrame, checked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidates that may stand for their field: no XPath that quotes an expected value, and for a weak field only confirmed
    paths, marked elements and structured paths that fit the concept. A ``[page]`` path is confirmed if its fixed twin is.
    Adds volatile."""
    given = candidates.withColumns({"confirmed": F.coalesce("confirmed", F.lit(False)) & (F.col("source") != "xpath"), "marked": F.coalesce("marked", F.lit(False))})
    first = W.partitionBy(*keys, *PATH).orderBy("seq")
    once = given.withColumn("confirmed", F.max("confirmed").over(W.partitionBy(*keys, *PATH))).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    # every transform of a confirmed path is confirmed
    twins = once.where("confirmed").select(*keys, "source", "path").distinct().groupBy(*keys, "source").agg(F.collect_list("path").alias("_confirmed"))
    told = once.join(twins, [*keys, "source"], "left")
    agreed = F.exists(F.coalesce("_confirmed", F.array().cast("array<string>")), lambda p: (p == F.col("path")) | is_fixed_twin(F.col("path"), p))
    facts = checked.groupBy(*keys).agg(F.any_value("concept").alias("concept"), F.any_value("weak").alias("weak"), F.collect_set("expected").alias("_values"))
    met = told.withColumn("confirmed", agreed).drop("_confirmed").join(facts, list(keys))
    quoting = (F.col("source") == "xpath") & F.exists("_values", lambda v: xpath_contains_value(F.col("path"), v))
    fits = reduce(lambda a, b: a | b, [(F.col("concept") == c) & fits_concept(c, F.col("path")) for c in CONCEPT_PATHS])
    stands = F.col("confirmed") | F.when(F.col("source") == "xpath", F.col("marked")).otherwise(F.coalesce(fits, F.lit(False)))
    kept = met.where(~quoting & (~F.col("weak") | stands))
    return kept.withColumn("volatile", (F.col("source") == "xpath") & looks_volatile(F.col("path"))).drop("_values", "concept", "weak")


def evaluated(checked: DataFrame, candidates: DataFrame, readings: DataFrame, keys: Sequence[str], kinds: Sequence[str] = TYPES, fold: bool = False) -> DataFrame:
    """``path_facts`` of every candidate on every captured, checked page of a field that some page has. Without a reading a path reads
    nothing.

    Candidates and readings go to the field's task once, where a path's readings become one array and meet the field's pages:
    the pages of a path lie in one task and are told together without a further shuffle."""
    given = candidates.select(*keys, *PATH, "seq", "confirmed", F.lit(True).alias("_given"))
    rows = given.unionByName(readings.select(*keys, *PATH, "url", "raw", "response"), allowMissingColumns=True).repartition(*keys)
    read = F.collect_list(F.when(F.col("_given").isNull(), F.struct("url", "raw", "response"))).alias("_read")
    paths = rows.groupBy(*keys, *PATH).agg(*[F.max(c).alias(c) for c in ("seq", "confirmed", "_given")], read).where("_given").drop("_given")
    of_page = ["url", "at", "expected", "absent", "default_cell", "page"]
    pages = checked.where(F.col("captured") & ~F.col("nowhere")).repartition(*keys)
    fields = pages.groupBy(*keys, "kind", "default_value", "complete").agg(F.collect_list(F.struct(*of_page)).alias("_pages"))

    def on(page):
        """The page with what the path reads on it."""
        given = lambda raw, response: F.struct(*[page[c].alias(c) for c in of_page], raw.alias("raw"), response.alias("response"))
        found = F.transform(F.filter("_read", lambda r: r["url"] == page["url"]), lambda r: given(r["raw"], r["response"]))
        nothing = F.lit(None).cast("string")
        return F.when(F.size(found) > 0, found).otherwise(F.array(given(nothing, nothing)))

    met = paths.join(fields, list(keys))

    def told(kind):
        """Facts of the paths of one kind; each kind in a plan of its own, null of any other."""
        of = met.where(F.col("kind").isNull() | ~F.col("kind").isin(*kinds)) if kind is None else met.where(F.col("kind") == kind)
        grid = of.select(*keys, *PATH, "seq", "confirmed", "default_value", "complete", F.inline(F.flatten(F.transform("_pages", on))))
        equal = F.lit(False) if kind is None else F.coalesce(values_equal(kind, F.col("raw"), F.col("expected"), fold=fold), F.lit(False))
        parses = F.lit(False) if kind is None else normalize(kind, F.col("raw"), fold=fold).isNotNull()
        empty = F.coalesce(F.col("raw"), F.lit("")) == ""
        seen = grid.withColumns({"empty": empty, "matches": ~empty & equal, "parses": parses})
        correct = F.when(F.col("absent"), F.col("empty")).when(F.col("default_cell"), F.col("empty") | F.col("matches")).otherwise(F.col("matches"))
        seen = seen.withColumn("correct", correct)
        return path_facts(seen.withColumn("proven", F.col("correct") & ~F.col("empty")), keys)

    return reduce(lambda x, y: x.unionByName(y), [told(kind) for kind in [*kinds, None]])


def path_facts(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per path: safe, everywhere, proven_pages (how many), the pages with a value, those of them it covers (is right or, beside a
    default, proven on) and those that may stay uncovered, how many pages there are, have a value and are right, and the readings."""
    valued = ~F.col("absent")
    pages = lambda test: F.collect_set(F.when(test, F.col("page")))
    stats = grid.groupBy(*keys, *PATH).agg(
        F.any_value("seq").alias("seq"),
        F.any_value("confirmed").alias("confirmed"),
        F.any_value("complete").alias("complete"),
        F.any_value("default_value").alias("default_value"),
        F.min(F.col("correct") | F.col("empty")).alias("safe"),
        F.min("correct").alias("right"),
        F.max("proven").alias("reads"),
        pages(valued).alias("valued_pages"),
        pages(valued & F.when(F.col("default_value").isNull(), F.col("correct")).otherwise(F.col("proven"))).alias("covered_pages"),
        pages(valued & F.col("default_cell")).alias("default_pages"),
        F.size(pages(valued & F.col("proven"))).alias("proven_pages"),
        F.min_by("response", F.when(F.col("response").isNotNull(), F.struct("at", "url"))).alias("first_response"),
        F.count("*").alias("n_pages"),
        F.count_if("correct").alias("n_right"),
        F.count_if(valued).alias("n_valued"),
        F.count_if(valued & F.col("correct")).alias("n_valued_right"),
        F.collect_list(F.struct("url", "raw", "response", "absent", "empty", "matches", "parses", "correct", "proven")).alias("read"),
    )
    safe = F.col("safe") & (F.col("default_value").isNull() | F.col("reads"))
    return stats.withColumn("safe", safe).withColumn("everywhere", F.col("safe") & F.col("right"))


def _response_sources(facts: DataFrame, safe: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Safe API paths with their source: paths that read one response on one page are one, transitively."""
    name = F.to_json(F.struct(*keys, *PATH))
    api = facts.where(F.col("source") == "api")
    own = [k for k in keys if k in api.columns]
    read = api.select(*own, *PATH, F.filter("read", lambda r: r["response"].isNotNull()).alias("read"))
    reads = safe.select(*keys, *PATH).join(read, [*own, *PATH]).select(*keys, *PATH, F.inline("read"))
    found = response_groups(reads.select(name.alias("path"), "url", F.to_json(F.struct(*keys, "response")).alias("response")))
    return safe.withColumn("_name", name).join(found.withColumnsRenamed({"path": "_name", "group": "_group"}), "_name", "left").drop("_name")


def _greedy(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Covers per field: of the ranked safe paths (rank, covered_pages, proven_pages), by most open pages, better rank on ties."""
    item = F.struct("rank", "covered_pages", "proven_pages")
    fields = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("paths"), F.any_value("valued_pages").alias("open"), F.any_value("default_pages").alias("spare"))
    start = F.struct(F.col("open").alias("open"), F.array().cast("array<int>").alias("chosen"))

    def step(state, _):
        gains = F.transform("paths", lambda p: F.struct(F.size(F.array_intersect(p["covered_pages"], state["open"])).alias("gain"), (-p["rank"]).alias("order"), p["covered_pages"].alias("pages")))
        # one element, the best path or a gain of nothing, bound to a name by the inner transform
        best = F.transform(F.array(F.array_max(gains)), lambda b: F.when(b["gain"] > 0, F.struct(F.array_except(state["open"], b["pages"]).alias("open"), F.array_append(state["chosen"], -b["order"]).alias("chosen"))).otherwise(state))
        return F.get(best, F.lit(0))

    state = fields.withColumn("_state", F.aggregate(F.sequence(F.lit(1), F.lit(MOST_PATHS)), start, step))
    state = state.select(*keys, "paths", "spare", "_state.open", "_state.chosen")
    whole = F.size(F.array_except("open", "spare")) == 0
    own = F.filter("paths", lambda p: F.array_contains(F.col("chosen"), p["rank"]))
    sorted_paths = F.array_sort(F.transform(own, lambda p: F.struct((-p["proven_pages"]).alias("less"), p["rank"].alias("rank"))))
    kept = state.where(whole).withColumn("_sorted", sorted_paths).where((F.size("_sorted") > 0) & (F.get("_sorted", F.lit(0))["less"] <= -2))
    return kept.select(*keys, F.posexplode("_sorted").alias("at", "p")).select(*keys, F.col("p.rank").alias("rank"), (F.col("at") + 1).alias("place"))


def _certify(facts: DataFrame, rounds: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Paths of each round with their facts and ranks, and the certified ones with how, place and container."""
    own = [k for k in keys if k in facts.columns]
    sets = ["valued_pages", "covered_pages", "default_pages"]
    met = rounds.select(*keys, *PATH).join(facts.drop("read", *sets), [*own, *PATH])
    ranked = rank_certified(met, list(keys)).withColumnRenamed("rank", "plain_rank")
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("confirmed").desc(), "plain_rank", "transform")))
    ranked = materialise(ranked, "ranked")
    safe = _response_sources(facts, ranked.where("safe"), keys)
    source_key = F.when(F.col("_group").isNotNull(), F.concat(F.lit("api#"), "_group")).otherwise(F.col("source"))
    named = safe.withColumn("_source", source_key).withColumn("pinned", F.col("confirmed"))
    leader = F.min_by("first_response", F.when(F.col("first_response").isNotNull(), F.col("rank")))
    named = materialise(named.withColumn("container", F.when(F.col("_group").isNotNull(), leader.over(W.partitionBy(*keys, "_source")))), "safe")
    pool = named.where(F.col("complete") & F.col("everywhere") & (F.col("default_value").isNull() | (F.col("proven_pages") >= 2)))
    columns = [*keys, *PATH, "place", "how", "container", "proven_pages"]
    layout = materialise(spread_sources(pool, list(keys), "_source").withColumn("how", F.lit("layout")).select(*columns), "layout")
    rest = named.where("complete").join(layout.select(*keys).distinct(), list(keys), "left_anti")
    # sets of pages grow with the pages, so that they join only the paths that a cover is sought among
    sought = rest.join(facts.select(*own, *PATH, *sets), [*own, *PATH])
    covers = _greedy(sought, keys).join(rest, [*keys, "rank"]).withColumn("how", F.lit("cover")).select(*columns)
    return ranked, layout.unionByName(covers)


def _cells(facts: DataFrame, ranked: DataFrame, certified: DataFrame, checked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(url, status, reason, found, near_misses) of every checked cell."""
    paths = ranked.select(*keys, *PATH, "seq", "safe", "everywhere", "plain_rank", "n_pages", "n_right", "n_valued", "n_valued_right")
    told = paths.join(certified.select(*keys, *PATH, "place"), [*keys, *PATH], "left")
    # a field's paths as one array, so that its cells lie in one task
    told = told.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in told.columns if c not in keys])).alias("_paths"))
    same = lambda p: reduce(lambda a, b: a & b, [p[c] == F.col(c) for c in PATH])
    told = told.join(facts.select(*keys, *PATH, "read"), list(keys)).select(*keys, "read", F.inline(F.filter("_paths", same)))
    told = told.select(*keys, "seq", "safe", "everywhere", "plain_rank", "n_pages", "n_right", "n_valued", "n_valued_right", "place", F.inline(F.transform("read", lambda r: F.struct(*[r[c].alias(c) for c in ("url", "raw", "absent", "empty", "matches", "parses", "correct", "proven")]))))
    right = F.col("correct").cast("int")
    valued = (~F.col("absent")).cast("int")
    told = told.withColumns({"_others": F.col("n_right") - right, "_pages": F.col("n_pages") - 1, "_valued_others": F.col("n_valued") - valued, "_valued_right": F.col("n_valued_right") - right * valued})
    all_others = (F.col("_pages") > 0) & (F.col("_others") == F.col("_pages"))
    first = lambda test, order, *names: F.min_by(F.struct("raw", *names), F.when(test, F.col(order)))
    misses = F.transform(F.array_sort(F.collect_list(F.when(~F.col("empty") & ~F.col("matches"), F.struct("seq", "raw")))), lambda m: m["raw"])
    per_cell = told.groupBy(*keys, "url").agg(
        first(F.col("place").isNotNull() & F.col("correct"), "place").alias("winner"),
        first(F.col("everywhere"), "plain_rank").alias("top"),
        first(~F.col("empty") & (F.col("_valued_others") > 0) & (F.col("_valued_right") == F.col("_valued_others")), "seq").alias("blamed"),
        first(all_others & ~F.col("correct"), "seq", "empty", "parses").alias("majority"),
        first(F.col("safe") & F.col("correct"), "plain_rank", "proven").alias("local"),
        F.max("proven").alias("proven_here"),
        F.max("correct").alias("correct_here"),
        F.slice(F.array_distinct(misses), 1, 3).alias("near_misses"),
    )
    has = certified.groupBy(*keys).agg(F.lit(True).alias("certified"))
    met = checked.join(per_cell, [*keys, "url"], "left").join(has, list(keys), "left")
    sure = F.coalesce("certified", F.lit(False))
    outcome = lambda status, reason=None, found=None, local=False: F.struct(
        F.lit(status).alias("status"), (F.lit(None).cast("string") if reason is None else reason).alias("reason"), (F.lit(None).cast("string") if found is None else found).alias("found"), F.lit(local).alias("local")
    )
    majority = F.col("majority")
    no = F.when(majority["empty"], F.when(F.col("proven_here"), "elsewhere").otherwise("not_found")).when(~majority["parses"], "type_mismatch").otherwise("different_value")
    known = F.coalesce(F.col("winner")["raw"], F.lit(""))
    result = (
        F.when(~F.col("captured"), outcome("not_captured"))
        .when(F.col("nowhere"), outcome("pass", found=F.lit("")))
        .when(sure, outcome("pass", found=known))
        .when(F.col("all_default"), outcome("pass", found=F.lit("")))
        .when(F.col("weak") & F.col("correct_here").isNull(), outcome("fail", F.lit("no_fitting_path")))
        .when(~F.col("complete") & F.col("top").isNotNull(), outcome("pass", found=F.coalesce(F.col("top")["raw"], F.lit(""))))
        .when(F.col("absent") & F.col("blamed").isNotNull(), outcome("fail", F.lit("found_unexpected"), F.col("blamed")["raw"]))
        .when(F.col("absent"), outcome("pass", found=F.lit("")))
        .when(majority.isNotNull(), outcome("fail", no, F.when(~majority["empty"], majority["raw"])))
        .when(F.col("complete") & F.col("local").isNotNull() & F.col("local")["proven"], outcome("pass", found=F.col("local")["raw"], local=True))
        .when(F.col("complete") & F.col("local").isNotNull(), outcome("pass", found=F.lit("")))
        .when(F.col("correct_here"), outcome("fail", F.lit("ambiguous")))
        .otherwise(outcome("fail", F.lit("not_found")))
    )
    given = met.withColumn("r", result)
    # a field that nothing certifies names a page: without one that fails, the pages found only locally do
    quiet = F.count(F.when(F.col("r.status") == "fail", 1)).over(W.partitionBy(*keys)) == 0
    unsure = quiet & ~sure & F.col("complete") & F.col("r.local")
    status, reason = F.when(unsure, "fail").otherwise(F.col("r.status")), F.when(unsure, "ambiguous").otherwise(F.col("r.reason"))
    near = F.when((status == "fail") & ~F.col("absent"), F.coalesce("near_misses", F.array().cast("array<string>")))
    return given.select(*keys, "url", status.alias("status"), reason.alias("reason"), F.when(~unsure, F.col("r.found")).alias("found"), near.alias("near_misses"))


def certify_fields(fields: DataFrame, cells: DataFrame, candidates: DataFrame, readings: DataFrame, keys: Sequence[str] = ("field",), kinds: Sequence[str] = TYPES, fold: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Certified paths, cell results and verdicts of all fields.

    Paths: keys, place, source, path, transform, how (layout or cover), container, proven_on (of a cover: number of its
    pages). Cells: keys, url, status, reason, found, near_misses. Verdicts: keys, state (layout, cover, default-only,
    not-on-website, incomplete or refused), weak_evidence, thin_evidence, volatile (only volatile XPaths certified it).

    Volatile XPaths take part only where the other paths certify nothing. A field without candidates, or without any
    checked page, has a verdict (refused) and no paths; repeated candidates count once, the first by ``seq``.
    """
    checked = materialise(checked_cells(fields, cells, keys, kinds, fold), "checked")
    fitting = materialise(fitting_candidates(candidates, checked, keys), "fitting")
    some = W.partitionBy(*keys)
    # round 0 leaves volatile paths out, where there are any; round 1 has all
    rounds = fitting.withColumn("_mixed", F.max("volatile").over(some) & F.max(~F.col("volatile")).over(some))
    rounds = rounds.withColumn("round", F.explode(F.when(F.col("_mixed") & ~F.col("volatile"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))))).drop("_mixed")
    deep = [*keys, "round"]
    facts = materialise(evaluated(checked, fitting, readings, keys, kinds, fold), "facts")
    ranked, certified = _certify(facts, rounds, deep)
    certified = materialise(certified, "certified")
    best = certified.groupBy(*keys).agg(F.min("round").alias("round"))
    chosen = fields.select(*keys).join(best, list(keys), "left").withColumn("round", F.coalesce("round", F.lit(1)))
    paths = certified.join(chosen, deep).drop("round")
    in_round = lambda df: df.join(chosen, deep).drop("round")
    results = _cells(facts, in_round(ranked), paths, checked, keys)
    paths = paths.withColumn("proven_on", F.when(F.col("how") == "cover", F.col("proven_pages"))).drop("proven_pages")
    told = checked.groupBy(*keys).agg(*[F.any_value(c).alias(c) for c in ("weak_evidence", "complete", "nowhere", "all_default")])
    volatile = fitting.where("volatile").select(*keys, *PATH, F.lit(True).alias("_volatile"))
    marks = paths.join(volatile, [*keys, *PATH], "left").groupBy(*keys).agg(F.any_value("how").alias("how"), F.max(F.coalesce(F.col("proven_on") == 1, F.lit(False))).alias("thin"), F.max(F.coalesce("_volatile", F.lit(False))).alias("volatile"))
    met = fields.select(*keys).join(told, list(keys), "left").join(marks, list(keys), "left")
    state = F.when(F.col("nowhere") & F.col("complete"), "not-on-website").otherwise(F.coalesce("how", F.when(F.col("all_default"), "default-only").when(~F.col("complete"), "incomplete").otherwise("refused")))
    false = F.lit(False)
    verdicts = met.select(*keys, state.alias("state"), F.coalesce("weak_evidence", false).alias("weak_evidence"), F.coalesce("thin", false).alias("thin_evidence"), F.coalesce("volatile", false).alias("volatile"))
    return paths, results, verdicts
