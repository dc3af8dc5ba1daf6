"""Queries of the value family: typed normalisation over amounts, names, dates and texts of the driver's tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skein.functions import dates as D
from skein.functions import numbers as N
from skein.functions import shape as S
from skein.functions import text as T
from skein.operators import contract
from skein.sources.tables import table


def _written(spark, folder):
    """Order totals as pages write them: six notations, told by the key."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    us = F.format_number("o_totalprice", 2)
    eu = F.translate(us, ",.", ".,")
    way = F.col("o_orderkey") % 6
    raw = (
        F.when(way == 0, F.concat(F.lit("$"), us))
        .when(way == 1, F.concat(eu, F.lit(" €")))
        .when(way == 2, F.format_string("%.2f", "o_totalprice"))
        .when(way == 3, F.concat(F.lit("USD "), F.format_number("o_totalprice", 0)))
        .when(way == 4, F.translate(F.format_number("o_totalprice", 0), ",", "."))
        .otherwise(F.lit("call us"))
    )
    return orders.select("o_orderkey", "o_totalprice", raw.alias("raw"))


_WRITTEN = """
WITH w AS (SELECT o_orderkey, o_totalprice, CASE o_orderkey % 6 WHEN 0 THEN '$' || format('{:,.2f}', o_totalprice) WHEN 1 THEN translate(format('{:,.2f}', o_totalprice), ',.', '.,') || ' €'
  WHEN 2 THEN printf('%.2f', o_totalprice) WHEN 3 THEN 'USD ' || format('{:,.0f}', o_totalprice) WHEN 4 THEN replace(format('{:,.0f}', o_totalprice), ',', '.') ELSE 'call us' END AS raw FROM orders),
b AS (SELECT *, regexp_replace(regexp_replace(raw, '[A-Za-z$€£¥₹\\s]', '', 'g'), '^[^\\d\\-+.,]+|[^\\d.,]+$', '', 'g') AS bare FROM w),
c AS (SELECT *, length(bare) - length(replace(bare, ',', '')) AS commas, length(bare) - length(replace(bare, '.', '')) AS dots, instr(reverse(bare), ',') AS comma, instr(reverse(bare), '.') AS dot FROM b),
n AS (SELECT *, CASE WHEN bare = '' THEN NULL WHEN comma > 0 AND dot > 0 AND comma < dot THEN replace(replace(bare, '.', ''), ',', '.') WHEN comma > 0 AND dot > 0 THEN replace(bare, ',', '')
    WHEN comma > 0 AND commas = 1 AND comma <> 4 THEN replace(bare, ',', '.') WHEN comma > 0 THEN replace(bare, ',', '') WHEN dots > 1 THEN replace(bare, '.', '') ELSE bare END AS as_number FROM c),
m AS (SELECT *, CASE WHEN commas = 0 AND dots = 1 AND dot = 4 THEN replace(bare, '.', '') ELSE as_number END AS as_money FROM n)
"""


def number_text(spark, folder):
    return _written(spark, folder).select("o_orderkey", "raw", N.number_text(F.col("raw")).alias("as_number"), N.number_text(F.col("raw"), money=True).alias("as_money"))


NUMBER_TEXT = _WRITTEN + "SELECT o_orderkey, raw, as_number, as_money FROM m"


def money(spark, folder):
    return _written(spark, folder).select("o_orderkey", N.money_text(F.col("raw")).alias("money"))


MONEY = _WRITTEN + "SELECT o_orderkey, printf('%.2f', floor(TRY_CAST(as_money AS DOUBLE) * 100 + 0.5) / 100) AS money FROM m"


def values_equal(spark, folder):
    """Pages' amounts against the table's: as money to the cent, as numbers with rounding allowed."""
    rows = _written(spark, folder).withColumn("expected", F.format_string("%.2f", "o_totalprice"))
    return rows.groupBy((F.col("o_orderkey") % 6).alias("notation")).agg(
        F.count_if(S.values_equal("money", F.col("raw"), F.col("expected"))).alias("equal_money"),
        F.count_if(N.nearly_equal(F.col("raw"), F.col("expected"))).alias("nearly_equal"),
    )


VALUES_EQUAL = _WRITTEN + """
, k AS (SELECT *, TRY_CAST(regexp_extract(regexp_replace(raw, '[^0-9.-]', '', 'g'), '^[-+]?(\\d+\\.?\\d*|\\.\\d+)') AS DOUBLE) AS x, o_totalprice AS y FROM m)
SELECT o_orderkey % 6 AS notation, count(*) FILTER (printf('%.2f', floor(TRY_CAST(as_money AS DOUBLE) * 100 + 0.5) / 100) = printf('%.2f', o_totalprice)) AS equal_money,
  count(*) FILTER (abs(x - CAST(printf('%.2f', y) AS DOUBLE)) / greatest(x, CAST(printf('%.2f', y) AS DOUBLE)) < 0.05) AS nearly_equal FROM k GROUP BY 1
"""


def rounding(spark, folder):
    """Shares shown with one decimal against their two-decimal values."""
    lines = table(spark, folder, "lineitem").select("l_quantity", "l_extendedprice").distinct()
    precise = F.format_string("%.4f", F.col("l_extendedprice") / 1000)
    shown = F.format_string("%.1f", F.floor(F.col("l_extendedprice") / 1000 * 10 + 0.5) / 10)
    return lines.groupBy("l_quantity").agg(F.count_if(N.rounds_to(shown, precise)).alias("rounds"), F.count_if(N.rounds_to(F.lit("5"), precise)).alias("whole"))


ROUNDING = """
WITH l AS (SELECT DISTINCT l_quantity, l_extendedprice FROM lineitem), t AS (SELECT l_quantity, printf('%.4f', l_extendedprice / 1000) AS p, printf('%.1f', floor(l_extendedprice / 1000 * 10 + 0.5) / 10) AS s FROM l)
SELECT l_quantity, count(*) FILTER (abs(CAST(p AS DOUBLE) - CAST(s AS DOUBLE)) <= 0.05::DOUBLE + 1e-9) AS rounds, CAST(0 AS BIGINT) AS whole FROM t GROUP BY 1
"""


def boolean_words(spark, folder):
    word = F.element_at(F.array(*[F.lit(w) for w in ("Yes", " in  stock", "SOLD OUT", "0", "maybe")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    parts = table(spark, folder, "part").select("p_partkey", word.alias("raw"))
    return parts.select("p_partkey", "raw", T.boolean_word(F.col("raw")).alias("value"))


BOOLEAN_WORDS = """
SELECT p_partkey, ['Yes', ' in  stock', 'SOLD OUT', '0', 'maybe'][1 + p_partkey % 5] AS raw, ['true', 'true', 'false', 'false', NULL][1 + p_partkey % 5] AS value FROM part
"""


def days(spark, folder):
    date = F.col("o_orderdate")
    way = F.col("o_orderkey") % 5
    raw = (
        F.when(way == 0, F.date_format(date, "yyyy-MM-dd"))
        .when(way == 1, F.date_format(date, "MMMM d, yyyy"))
        .when(way == 2, F.date_format(date, "d MMM yyyy"))
        .when(way == 3, F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit("T23:30:00-05:00")))
        .otherwise(F.lit("soon"))
    )
    return table(spark, folder, "orders").select("o_orderkey", D.day(raw).alias("day"))


DAYS = """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') WHEN 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders
"""


def text_lists(spark, folder):
    raw = F.concat_ws("; ", F.upper("p_type"), "p_name", F.replace("p_name", F.lit(" "), F.lit(",")), F.lit(" "))
    return table(spark, folder, "part").select("p_partkey", F.array_join(T.list_items(raw), "|").alias("items"))


TEXT_LISTS = """
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(concat_ws('; ', upper(p_type), p_name, replace(p_name, ' ', ','), ' '), '[\\n,;]'), lambda x: lower(trim(x))), lambda x: x <> ''))), '|') AS items FROM part
"""


def after_labels(spark, folder):
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Style:  "), "p_brand")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("No 5: "), "p_brand")).otherwise(F.col("p_name"))
    return table(spark, folder, "part").select("p_partkey", T.after_label(raw).alias("value"))


AFTER_LABELS = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS value FROM part"


def transforms(spark, folder):
    """Prices given in cents against the price in units: which transform makes them equal."""
    cents = F.col("p_retailprice") * 100
    raw = F.when(F.col("p_partkey") % 2 == 0, F.floor(cents + 0.5).cast("string")).otherwise(F.format_string("%.2f", "p_retailprice"))
    rows = table(spark, folder, "part").select("p_partkey", raw.alias("raw"), F.format_string("%.2f", "p_retailprice").alias("expected"))
    return rows.select("p_partkey", F.coalesce(S.infer_transform("money", F.col("raw"), F.col("expected")), F.lit("none")).alias("transform"))


TRANSFORMS = "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'cents_to_units' ELSE 'identity' END AS transform FROM part"


def shape_checks(spark, folder):
    raw = F.when(F.col("p_partkey") % 4 == 0, F.lit("Add to Cart")).when(F.col("p_partkey") % 4 == 1, F.lit(" ")).when(F.col("p_partkey") % 4 == 2, F.format_string("$%.2f", "p_retailprice")).otherwise(F.col("p_name"))
    rows = table(spark, folder, "part").select("p_partkey", raw.alias("raw"))
    s, n = S.shape_check(F.col("raw"), "string", "description"), S.shape_check(F.col("raw"), "number")
    return rows.select("p_partkey", s["ok"].alias("is_text"), F.coalesce(s["reason"], F.lit("")).alias("text_reason"), n["ok"].alias("is_number"), F.coalesce(n["normalized"].cast("double"), F.lit(-1.0)).alias("number"))


SHAPE_CHECKS = """
WITH r AS (SELECT p_partkey, p_partkey % 4 AS k, CASE p_partkey % 4 WHEN 0 THEN 'Add to Cart' WHEN 1 THEN ' ' WHEN 2 THEN printf('$%.2f', p_retailprice) ELSE p_name END AS raw, p_retailprice FROM part)
SELECT p_partkey, k = 3 AND length(trim(raw)) >= 20 AS is_text, CASE k WHEN 0 THEN 'looks like UI label' WHEN 1 THEN 'empty string' WHEN 2 THEN 'description too short' ELSE CASE WHEN length(trim(raw)) < 20 THEN 'description too short' ELSE '' END END AS text_reason,
  k = 2 AS is_number, CASE WHEN k = 2 THEN CAST(printf('%.2f', p_retailprice) AS DOUBLE) ELSE -1.0::DOUBLE END AS number FROM r
"""


def schedules(spark, folder):
    """The next Monday or Thursday, 06:00 in New York, after each order date."""
    orders = table(spark, folder, "orders").select("o_orderdate").distinct()
    after = F.col("o_orderdate").cast("timestamp")
    return orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), F.unix_seconds(D.next_run_at(after, [1, 4], 6, 0, "America/New_York")).alias("next_run"))


SCHEDULES = """
WITH d AS (SELECT DISTINCT o_orderdate FROM orders), c AS (SELECT o_orderdate, (date_trunc('day', o_orderdate) + to_days(CAST(i AS INTEGER)) + INTERVAL 6 HOUR) AS wall FROM d, range(-1, 9) r(i)),
u AS (SELECT o_orderdate, CAST(epoch(timezone('America/New_York', wall)) AS BIGINT) AS t FROM c WHERE isodow(wall) IN (1, 4))
SELECT strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, min(t) AS next_run FROM u WHERE t > epoch(u.o_orderdate) GROUP BY 1
"""


def slugs(spark, folder):
    """Slugs of part names, later repeats numbered."""
    from pyspark.sql import Window as W

    named = table(spark, folder, "part").select("p_partkey", T.slug("p_name").alias("slug"))
    nth = F.row_number().over(W.partitionBy("slug").orderBy("p_partkey"))
    return named.select("p_partkey", F.when(nth == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", nth.cast("string"))).alias("slug"))


SLUGS = """
WITH s AS (SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS k FROM s)
SELECT p_partkey, CASE WHEN k = 1 THEN slug ELSE slug || '-' || k END AS slug FROM n
"""


#: Words up to this length meet the tokens in them by their substrings; the few longer ones are searched.
LONGEST = 300
#: Tokens are told apart by so many characters first (none is shorter: ``long_words``).
HEAD = 3
#: A task keeps what it found in so many words; then it begins anew.
KEPT_WORDS = 1 << 18


def _shares(passages):
    """Batches of texts (doc_id, seen) to (doc_id, item_id, share). ``passages`` are rows of item_id and tokens, which hold no
    spaces: a text shows a token if one of its words does, so that a word is looked through once for all texts of a task that have it."""
    ids = {t: n for n, t in enumerate(sorted({t for p in passages for t in p.tokens}))}
    heads = {}
    for t in sorted(ids, key=len):
        heads.setdefault(t[:HEAD], {})[len(t)] = True
    owners = [[] for _ in ids]
    for n, p in enumerate(passages):
        for t in p.tokens:
            owners[ids[t]].append(n)
    owners = [np.array(o) for o in owners]
    items, sizes = pa.array([p.item_id for p in passages], pa.int64()), np.array([len(p.tokens) for p in passages])

    def tokens_in(word):
        if len(word) > LONGEST:
            return tuple(n for t, n in ids.items() if t in word)
        return tuple(ids[part] for at in range(len(word)) for n in heads.get(word[at : at + HEAD], ()) if (part := word[at : at + n]) in ids)

    def run(batches):
        known = {}
        for batch in batches:
            docs, places, shares = [], [], []
            for doc, seen in zip(batch.column("doc_id").to_pylist(), batch.column("seen").to_pylist()):
                shown = set()
                for word in set((seen or "").split(" ")):
                    found = known.get(word)
                    if found is None:
                        found = tokens_in(word)
                        if len(word) <= LONGEST:
                            known[word] = found
                    shown.update(found)
                if len(known) > KEPT_WORDS:
                    known.clear()
                if shown:
                    share = np.bincount(np.concatenate([owners[n] for n in shown]), minlength=len(sizes)) / sizes
                    good = np.flatnonzero(share >= 0.6)
                    docs.append(np.full(len(good), doc))
                    places.append(good)
                    shares.append(share[good])
            if docs:
                yield pa.record_batch([pa.array(np.concatenate(docs), pa.int64()), items.take(pa.array(np.concatenate(places))), pa.array(np.concatenate(shares))], ["doc_id", "item_id", "share"])

    return run


def corroboration(spark, folder):
    """Documents whose text shows at least 0.6 of a benchmark passage's words. The passages' words go to every task, and each
    text is read once, where it lies, for all of them."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("long"), T.prepared(F.col("text")).alias("seen"))
    passages = table(spark, folder, "benchmark").select(F.col("item_id").cast("long"), T.long_words(F.col("text")).alias("tokens")).where(F.size("tokens") > 0).collect()
    return docs.mapInArrow(_shares(passages), "doc_id long, item_id long, share double")


CORROBORATION = """
WITH k AS (SELECT item_id, list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '[\\s\\x{00A0}]+', ' ', 'g')), ' '), lambda x: length(x) >= 3) AS t FROM benchmark),
d AS (SELECT doc_id, trim(regexp_replace(lower(text), '[\\s\\x{00A0}]+', ' ', 'g')) AS flat FROM documents)
SELECT * FROM (SELECT doc_id, item_id, len(list_filter(t, lambda x: contains(flat, x))) / len(t) AS share FROM d, k WHERE len(t) > 0) WHERE share >= 0.6
"""


def field_lists(spark, folder):
    lists = table(spark, folder, "region").select("r_regionkey", F.concat(F.lit("Product Name, listPrice: the old one, in_stock, image url, Product Name,"), "r_name").alias("raw"))
    return contract.parse_field_list(lists, ["r_regionkey"], "raw").select("r_regionkey", "pos", "key", F.coalesce("hint", F.lit("")).alias("hint"), "type")


FIELD_LISTS = """
WITH f AS (SELECT r_regionkey, r_name, unnest([(0, 'product_name', '', 'string'), (1, 'list_price', 'the old one', 'price'), (2, 'in_stock', '', 'boolean'), (3, 'image_url', '', 'image_url'), (5, replace(lower(r_name), ' ', '_'), '', 'string')]) AS t FROM region)
SELECT r_regionkey, CAST(t[1] AS INTEGER) AS pos, t[2] AS "key", t[3] AS hint, t[4] AS type FROM f
"""


def durations(spark, folder):
    spans = table(spark, folder, "events").groupBy("user_id").agg((F.max(F.unix_seconds(F.col("ts").cast("timestamp"))) - F.min(F.unix_seconds(F.col("ts").cast("timestamp")))).alias("s"))
    return spans.select("user_id", D.duration_label(F.col("s")).alias("label"))


DURATIONS = """
WITH s AS (SELECT user_id, max(epoch_us(ts) // 1000000) - min(epoch_us(ts) // 1000000) AS s FROM events GROUP BY 1)
SELECT user_id, CASE WHEN s < 60 THEN printf('%d s', s) WHEN m < 60 THEN printf('%d min', m) ELSE printf('%d h %02d min', m // 60, m % 60) END AS label FROM (SELECT *, CAST(floor(s / 60.0::DOUBLE + 0.5) AS BIGINT) AS m FROM s)
"""


QUERIES = {
    "number_text": (number_text, NUMBER_TEXT),
    "money": (money, MONEY),
    "values_equal": (values_equal, VALUES_EQUAL),
    "rounding": (rounding, ROUNDING),
    "boolean_words": (boolean_words, BOOLEAN_WORDS),
    "days": (days, DAYS),
    "text_lists": (text_lists, TEXT_LISTS),
    "after_labels": (after_labels, AFTER_LABELS),
    "transforms": (transforms, TRANSFORMS),
    "shape_checks": (shape_checks, SHAPE_CHECKS),
    "schedules": (schedules, SCHEDULES),
    "slugs": (slugs, SLUGS),
    "corroboration": (corroboration, CORROBORATION),
    "field_lists": (field_lists, FIELD_LISTS),
    "durations": (durations, DURATIONS),
}
