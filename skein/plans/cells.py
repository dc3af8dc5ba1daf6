"""Queries of the cell family: coverage, misses, drift, quality, merges, over documents and their labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.emptiness import is_empty
from skein.operators import cells as C
from skein.operators import quality as Q
from skein.operators import reports
from skein.sources.tables import table


def _labelled(spark, folder):
    """Documents with their labels as cells: most are empty, as labels cover some documents only."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id", "left")


FIELDS = ["lang", "quality", "toxic"]
_CELLS = """
WITH r AS (SELECT d.doc_id, source, lang, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
cells AS (SELECT doc_id, source, 'lang' AS field, lang AS value FROM r UNION ALL SELECT doc_id, source, 'quality', CAST(quality AS VARCHAR) FROM r
  UNION ALL SELECT doc_id, source, 'toxic', CAST(toxic AS VARCHAR) FROM r)
"""


def _cells(spark, folder):
    return C.unpivot_cells(_labelled(spark, folder), ["doc_id", "source"], FIELDS)


def coverage(spark, folder):
    """Fields confirmed absent on every fifth document; a shown flag by parity, null on every third."""
    absent = (F.col("doc_id") % 5 == 0) & (F.col("field") == "toxic")
    shown = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 2 == 0)
    return C.coverage(_cells(spark, folder), absent, shown, (F.col("field") == "lang") & (F.col("doc_id") % 4 == 0))


COVERAGE = _CELLS + """
SELECT field, count(*) AS total, count(*) FILTER (f) AS filled, count(*) FILTER (NOT f AND a) AS confirmed_absent, count(*) FILTER (NOT f AND NOT a) AS missing,
  count(s) AS checked, count(*) FILTER (NOT s) AS not_shown, count(*) FILTER (field = 'lang' AND doc_id % 4 = 0) AS defaulted
FROM (SELECT *, value IS NOT NULL AND value <> '' AS f, doc_id % 5 = 0 AND field = 'toxic' AS a, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 2 = 0 END AS s FROM cells) GROUP BY 1
"""


def gap_items(spark, folder):
    gaps = C.gap_items(_cells(spark, folder), ["doc_id"], F.col("doc_id") % 5 == 0)
    return gaps.select("doc_id", F.array_join("missing_fields", ",").alias("missing_fields"))


GAP_ITEMS = _CELLS + "SELECT doc_id, string_agg(field, ',' ORDER BY field) AS missing_fields FROM cells WHERE (value IS NULL OR value = '') AND doc_id % 5 <> 0 GROUP BY 1"


def misses(spark, folder):
    found = C.misses(_cells(spark, folder), "source", "doc_id", F.lit(False))
    return found.select("field", "source", "count", F.concat_ws(",", F.transform("urls", lambda u: u.cast("string"))).alias("urls"))


MISSES = _CELLS + """
SELECT field, source, count(*) AS count, array_to_string(list_sort(list(doc_id))[1:10], ',') AS urls FROM cells WHERE value IS NULL OR value = '' GROUP BY 1, 2
"""


def empty_shares(spark, folder):
    return C.empty_shares(_cells(spark, folder), ["source"])


EMPTY_SHARES = _CELLS + "SELECT source, field, count(*) AS rows, avg(CASE WHEN value IS NULL OR value = '' THEN 1.0::DOUBLE ELSE 0 END) AS empty_share FROM cells GROUP BY 1, 2"


def drifted(spark, folder):
    return C.drifted(_cells(spark, folder), ["source"])


DRIFTED = "SELECT * FROM (" + EMPTY_SHARES.strip() + ") WHERE rows >= 5 AND empty_share >= 0.2"


def field_coverage(spark, folder):
    return C.field_coverage(_cells(spark, folder), ["doc_id"]).select(F.floor(F.col("field_coverage") * 1e9 + 0.5).alias("field_coverage_e9"))


FIELD_COVERAGE = _CELLS + "SELECT CAST(floor(avg(share) * 1e9 + 0.5) AS BIGINT) AS field_coverage_e9 FROM (SELECT doc_id, avg(CASE WHEN value IS NULL THEN 0.0::DOUBLE ELSE 1 END) AS share FROM cells GROUP BY 1)"


def missing_fields(spark, folder):
    return C.missing_fields(_cells(spark, folder))


MISSING_FIELDS = _CELLS + "SELECT field, count(value) AS present, count(*) AS rows FROM cells GROUP BY 1 HAVING count(value) <= count(*) * 0.5"


def classify_fields(spark, folder):
    return C.classify_fields(C.coverage(_cells(spark, folder), F.lit(False))).select("field", "total", "filled", "fill_share", "state")


CLASSIFY_FIELDS = _CELLS + """
SELECT field, total, filled, filled / total AS fill_share, CASE WHEN filled / total < 0.5 THEN 'dead' ELSE 'alive' END AS state
FROM (SELECT field, count(*) AS total, count(*) FILTER (value IS NOT NULL AND value <> '') AS filled FROM cells GROUP BY 1)
"""


def cross_row(spark, folder):
    rows = table(spark, folder, "supplier").select("s_suppkey", "s_name", F.lit("EUR").alias("currency"), F.when(F.col("s_suppkey") % 3 == 0, "x").alias("note"))
    return C.cross_row_issues(C.unpivot_cells(rows, ["s_suppkey"], ["s_name", "currency", "note"]), required=["note", "s_name"])


CROSS_ROW = """
WITH n AS (SELECT count(*) AS n, count(*) FILTER (s_suppkey % 3 = 0) AS k FROM supplier)
SELECT 'currency' AS field, 'All ' || n || ' rows have identical value — likely wrong selector' AS message FROM n
UNION ALL SELECT 'note', 'All ' || k || ' rows have identical value — likely wrong selector' FROM n WHERE k > 1
UNION ALL SELECT 'note', 'Required field missing in ' || (n - k) || '/' || n || ' rows' FROM n WHERE k < n * 0.5
"""


def defaults(spark, folder):
    rows = _labelled(spark, folder).select("doc_id", F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic"))
    done = C.apply_defaults(rows, {"quality": "1", "toxic": "0"})
    return done.withColumn("defaulted", F.array_join("defaulted", ","))


DEFAULTS = """
SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), '1') AS quality, coalesce(CAST(toxic AS VARCHAR), '0') AS toxic,
  concat_ws(',', CASE WHEN quality IS NULL THEN 'quality' END, CASE WHEN toxic IS NULL THEN 'toxic' END) AS defaulted FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""


def merge_backfill(spark, folder):
    """A later run's labels fill the gaps of an earlier one; what was filled stays."""
    labels = table(spark, folder, "labels")
    docs = table(spark, folder, "documents").select("doc_id")
    parent = docs.join(labels.where("doc_id % 2 = 0").select("doc_id", F.col("quality").cast("string").alias("quality"), F.when(F.col("doc_id") % 4 == 0, F.col("toxic").cast("string")).alias("toxic")), "doc_id", "left")
    child = labels.select("doc_id", (1 - F.col("quality")).cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic"))
    merged = C.merge_backfill(parent, child, ["doc_id"], ["quality", "toxic"])
    return merged.withColumns({c: F.array_join(c, ",") for c in ("filled_fields", "absent_fields")})


MERGE_BACKFILL = """
WITH p AS (SELECT d.doc_id, CAST(quality AS VARCHAR) AS quality, CASE WHEN d.doc_id % 4 = 0 THEN CAST(toxic AS VARCHAR) END AS toxic FROM documents d LEFT JOIN (FROM labels WHERE doc_id % 2 = 0) l ON l.doc_id = d.doc_id)
SELECT p.doc_id, coalesce(p.quality, CAST(1 - c.quality AS VARCHAR)) AS quality, coalesce(p.toxic, CAST(c.toxic AS VARCHAR)) AS toxic,
  concat_ws(',', CASE WHEN p.quality IS NULL AND c.quality IS NOT NULL THEN 'quality' END, CASE WHEN p.toxic IS NULL AND c.toxic IS NOT NULL THEN 'toxic' END) AS filled_fields,
  concat_ws(',', CASE WHEN coalesce(p.quality, CAST(c.quality AS VARCHAR)) IS NULL THEN 'quality' END, CASE WHEN coalesce(p.toxic, CAST(c.toxic AS VARCHAR)) IS NULL THEN 'toxic' END) AS absent_fields
FROM p LEFT JOIN labels c ON c.doc_id = p.doc_id
"""


def backfill_plan(spark, folder):
    gaps = C.gap_items(_cells(spark, folder), ["doc_id"], F.lit(False))
    return C.backfill_items(gaps, ["toxic", "lang"]).select("doc_id", F.array_join("target_fields", ",").alias("target_fields"))


BACKFILL_PLAN = _CELLS + "SELECT doc_id, string_agg(field, ',' ORDER BY field DESC) AS target_fields FROM cells WHERE (value IS NULL OR value = '') AND field IN ('toxic', 'lang') GROUP BY 1"


def repair_sweep(spark, folder):
    """First three documents of each source: two with a label or more let the sweep go on."""
    return C.repair_verdict(_labelled(spark, folder), "source", [F.col("doc_id")], F.col("quality").isNotNull())


REPAIR_SWEEP = """
SELECT source, count(*) AS tried, count(quality) AS resolved, count(quality) >= 2 AS goes_on FROM
(SELECT d.doc_id, source, quality, row_number() OVER (PARTITION BY source ORDER BY d.doc_id) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) WHERE n <= 3 GROUP BY 1
"""


def quality_issues(spark, folder):
    """Checks of three types over customers: balances as prices, names as texts, segments as yes/no."""
    rows = table(spark, folder, "customer").select(
        "c_custkey", F.format_string("$%.2f", "c_acctbal").alias("balance"), F.concat(F.lit("<b>"), "c_name", F.lit("</b>")).alias("name"), F.when(F.col("c_custkey") % 2 == 0, "Yes").otherwise(F.col("c_mktsegment")).alias("active")
    )
    return Q.validate(rows, ["c_custkey"], {"balance": "price", "name": "string", "active": "boolean"})


QUALITY_ISSUES = """
WITH c AS (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN 'Yes' ELSE c_mktsegment END AS active FROM customer)
SELECT c_custkey, 'balance' AS field, 'warning' AS severity, 'Price parsed from string' AS message, true AS fixed FROM c
UNION ALL SELECT c_custkey, 'balance', 'error', 'Price is negative', false FROM c WHERE CAST(printf('%.2f', c_acctbal) AS DOUBLE) < 0
UNION ALL SELECT c_custkey, 'balance', 'warning', 'Price is zero (may be intentional)', false FROM c WHERE CAST(printf('%.2f', c_acctbal) AS DOUBLE) = 0
UNION ALL SELECT c_custkey, 'name', 'warning', 'Stripped HTML tags from value', true FROM c
UNION ALL SELECT c_custkey, 'active', 'warning', 'Converted "Yes" to true', true FROM c WHERE active = 'Yes'
UNION ALL SELECT c_custkey, 'active', 'error', 'Cannot convert to boolean: "' || active || '"', false FROM c WHERE active <> 'Yes'
"""


def result_rows(spark, folder):
    return C.result_rows(_labelled(spark, folder), ["doc_id"], {"quality": "number", "lang": "text"})


RESULT_ROWS = """
WITH r AS (SELECT d.doc_id, lang, CAST(quality AS VARCHAR) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT doc_id, 'quality' AS name, 'number' AS type, quality AS value, CASE WHEN quality IS NULL THEN 'not_found' ELSE 'found' END AS status FROM r
UNION ALL SELECT doc_id, 'lang', 'text', lang, CASE WHEN coalesce(lang, '') = '' THEN 'not_found' ELSE 'found' END FROM r
"""


def cell_states(spark, folder):
    state = C.cell_state(F.col("value"), F.col("doc_id") % 5 == 0)
    return _cells(spark, folder).groupBy("field", state.alias("state")).agg(F.count("*").alias("cells"))


CELL_STATES = _CELLS + "SELECT field, CASE WHEN coalesce(value, '') <> '' THEN 'filled' WHEN doc_id % 5 = 0 THEN 'absent' ELSE 'missing' END AS state, count(*) AS cells FROM cells GROUP BY 1, 2"


def verdict_summary(spark, folder):
    verdict = F.when(F.col("quality").isNull(), "missing").when(F.col("quality") == 1, "correct").otherwise("wrong")
    return reports.verdict_summary(_labelled(spark, folder).select("source", verdict.alias("verdict")), ["source"])


VERDICT_SUMMARY = """
SELECT source, count(*) FILTER (quality = 1) AS correct, count(*) FILTER (quality = 0) AS wrong, count(*) FILTER (quality IS NULL) AS missing,
  CASE WHEN count(quality) > 0 THEN count(*) FILTER (quality = 1) * 100.0::DOUBLE / count(quality) END AS percent FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1
"""


def agreement(spark, folder):
    """Agreement by probability bucket: label parity against a probability made from the id."""
    labels = table(spark, folder, "labels").withColumn("p", (F.col("doc_id") % 100) / 100.0)
    return reports.agreement(labels.withColumn("bucket", reports.probability_bucket(F.col("p"))), ["bucket"], F.col("quality") == 1)


AGREEMENT = """
SELECT CASE WHEN p >= 0.9 THEN '>=0.9' WHEN p >= 0.8 THEN '0.8-0.9' WHEN p >= 0.6 THEN '0.6-0.8' ELSE '<0.6' END AS bucket, count(*) AS judged, count(*) FILTER (quality = 1) AS agreed,
  count(*) FILTER (quality = 1) / count(*) AS share FROM (SELECT quality, (doc_id % 100) / 100.0::DOUBLE AS p FROM labels) GROUP BY 1
"""


def diagnosis(spark, folder):
    kind = F.when(F.col("event_type") == "error", "extraction").when(F.col("event_type") == "signup", "pagination").when(F.col("value") > 200, "blocked")
    return reports.diagnosis(table(spark, folder, "events").select("user_id", kind.alias("kind")), ["user_id"])


DIAGNOSIS = """
SELECT user_id, CASE min(CASE kind WHEN 'blocked' THEN 1 WHEN 'pagination' THEN 3 ELSE 5 END) WHEN 1 THEN 'blocked' WHEN 3 THEN 'pagination' ELSE 'extraction' END AS diagnosis
FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN 'extraction' WHEN event_type = 'signup' THEN 'pagination' WHEN value > 200 THEN 'blocked' END AS kind FROM events) WHERE kind IS NOT NULL GROUP BY 1
"""


def coverage_explanation(spark, folder):
    rows = _labelled(spark, folder).withColumns({"is_long": F.col("n_chars") > 100, "is_english": F.coalesce(F.col("lang") == "en", F.lit(False)), "any": F.lit(True)})
    return reports.coverage_explanations(rows, ["is_long", "is_english", "any"], is_empty(F.col("quality")), (F.col("doc_id") < 3) & (F.col("n_chars") < 0))


COVERAGE_EXPLANATION = """
WITH r AS (SELECT n_chars > 100 AS is_long, coalesce(lang = 'en', false) AS is_english, true AS "any" FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NULL),
u AS (UNPIVOT r ON is_long, is_english, "any" INTO NAME feature VALUE has)
SELECT feature, count(*) AS empty_pages, count(*) FILTER (has) AS with_feature, CAST(0 AS BIGINT) AS proof_with FROM u GROUP BY 1 HAVING count(*) FILTER (has) >= 0.8 * count(*)
"""


QUERIES = {
    "coverage": (coverage, COVERAGE),
    "gap_items": (gap_items, GAP_ITEMS),
    "misses": (misses, MISSES),
    "empty_shares": (empty_shares, EMPTY_SHARES),
    "drifted": (drifted, DRIFTED),
    "field_coverage": (field_coverage, FIELD_COVERAGE),
    "missing_fields": (missing_fields, MISSING_FIELDS),
    "classify_fields": (classify_fields, CLASSIFY_FIELDS),
    "cross_row": (cross_row, CROSS_ROW),
    "defaults": (defaults, DEFAULTS),
    "merge_backfill": (merge_backfill, MERGE_BACKFILL),
    "backfill_plan": (backfill_plan, BACKFILL_PLAN),
    "repair_sweep": (repair_sweep, REPAIR_SWEEP),
    "quality_issues": (quality_issues, QUALITY_ISSUES),
    "result_rows": (result_rows, RESULT_ROWS),
    "cell_states": (cell_states, CELL_STATES),
    "verdict_summary": (verdict_summary, VERDICT_SUMMARY),
    "agreement": (agreement, AGREEMENT),
    "diagnosis": (diagnosis, DIAGNOSIS),
    "coverage_explanation": (coverage_explanation, COVERAGE_EXPLANATION),
}
