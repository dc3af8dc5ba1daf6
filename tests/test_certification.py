"""Certification of fields: every way a field can be certified or refused, on hand-made pages."""

import pytest

from skein.operators.certification import certify_fields, is_fixed_twin
from pyspark.sql import functions as F

FIELD = "field string, kind string, concept string, default_value string"
CELL = "field string, url string, at int, expected string, absent boolean, captured boolean"
CANDIDATE = "field string, source string, path string, transform string, seq int, confirmed boolean, marked boolean"
READING = "field string, source string, path string, transform string, url string, raw string, response string"


def run(spark, fields):
    """``fields``: name -> kind, concept, default, pages ({url: expected, None for not captured, or ABSENT}), paths
    ({"source:path": ([values by page], confirmed, response)})."""
    rows, cells, candidates, readings = [], [], [], []
    for name, (kind, concept, default, pages, paths) in fields.items():
        rows.append((name, kind, concept, default))
        for at, (url, expected) in enumerate(pages.items()):
            cells.append((name, url, at, None if expected == "ABSENT" else expected.rstrip("!") if expected else expected, expected == "ABSENT", not (expected or "").endswith("!")))
        for seq, (path, told) in enumerate(paths.items()):
            values, confirmed, response = told if isinstance(told, tuple) else (told, False, None)
            source, bare = path.split(":", 1)
            candidates.append((name, source, bare, "identity", seq, confirmed, path.startswith("xpath:/marked")))
            readings += [(name, source, bare, "identity", url, v, response) for url, v in zip(pages, values)]
    tables = [spark.createDataFrame(r, s) for r, s in ((rows, FIELD), (cells, CELL), (candidates, CANDIDATE), (readings, READING))]
    paths, results, verdicts = certify_fields(*tables, kinds=("text", "number", "boolean", "money"))
    certified, cells = {}, {}
    for r in paths.orderBy("place").collect():
        certified.setdefault(r.field, []).append(f"{r.source}:{r.path}")
    for r in results.collect():
        cells.setdefault(r.field, {})[r.url] = r.status if r.reason is None else r.reason
    return certified, cells, {r.field: r for r in verdicts.collect()}, results


P3 = {"1": "a", "2": "b", "3": "c"}


@pytest.fixture(scope="module")
def outcome(spark):
    return run(
        spark,
        {
            "layout": ("text", "x", None, P3, {"xpath:/p": ["a", "b", "c"], "api:deep.name": ["a", "b", "c"], "api:n": ["a", "b", "c"], "api:mm": ["A", "b", "c"], "meta:m": ["a", "b", "z"]}),
            "cover": ("text", "x", None, P3, {"api:p": ["a", "b", None], "api:q": [None, None, "c"], "api:bad": ["z", "b", "c"]}),
            "lonely": ("text", "x", None, {"1": "a", "2": "b"}, {"api:p": ["a", None], "api:q": [None, "b"]}),
            "wrong": ("text", "x", None, P3, {"api:p": ["a", "b", "z"], "api:q": [None, None, "y"]}),
            "elsewhere": ("text", "x", None, P3, {"api:p": ["a", "b", None], "api:q": ["z", None, "c"]}),
            "mismatch": ("number", "x", None, {"1": "1", "2": "2", "3": "3"}, {"api:p": ["1", "2.0", "none"]}),
            "weak": ("text", "brand", None, {"1": "W", "2": "w"}, {"api:other": ["W", "W"], "api:a.brand": ["W", "W"], "xpath:/x": ["W", "W"], "xpath:/marked": ["W", "W"]}),
            "weakless": ("boolean", "availability", None, {"1": "yes", "2": "no"}, {"api:other": ["yes", "no"]}),
            "confirmed": ("boolean", "q", None, {"1": "yes", "2": "no"}, {"api:l[0].v": (["true", "false"], True, None), "api:l[page].v": ["true", "false"]}),
            "absent": ("text", "x", None, {"1": "a", "2": "b", "3": "ABSENT"}, {"api:p": ["a", "b", "z"], "api:q": ["a", "b", None]}),
            "unexpected": ("text", "x", None, {"1": "a", "2": "b", "3": "ABSENT"}, {"api:p": ["a", "b", "z"]}),
            "nowhere": ("text", "x", None, {"1": "ABSENT", "2": "ABSENT"}, {"api:p": ["a", None]}),
            "default": ("text", "x", "d", {"1": "a", "2": "b", "3": None}, {"api:p": ["a", "b", None], "api:one": ["a", "z", "d"]}),
            "default_only": ("text", "x", "d", {"1": "d", "2": None}, {"api:p": ["d", None]}),
            "volatile": ("text", "x", None, {"1": "one", "2": "two", "3": "six"}, {'xpath://a[@id="v-11.1.8"]': ["one", "two", "six"], "api:p": ["z", "two", "six"]}),
            "stable": ("text", "x", None, {"1": "one", "2": "two"}, {'xpath://a[@id="v-11.1.8"]': ["one", "two"], "api:p": ["one", "two"]}),
            "quoting": ("text", "x", None, {"1": "anna", "2": "berta"}, {'xpath://a[@title="Anna"]': ["anna", None], "api:p": [None, "berta"]}),
            "missing": ("text", "x", None, {"1": "a", "2": "b!", "3": "c"}, {"api:p": ["a", None, "c"]}),
            "unchecked": ("text", "x", None, {"1": "a", "2": "b", "3": ""}, {"api:p": ["a", "b", "z"]}),
            "one_response": ("text", "x", None, P3, {"api:a": (["a", "b", "c"], False, "r1"), "api:bb": (["a", "b", "c"], False, "r1"), "api:ccc": (["a", "b", "c"], False, "r1"), "api:dddd": (["a", "b", "c"], False, "r2")}),
            "bare": ("text", "x", None, {"1": "a"}, {}),
        },
    )


def test_certified_paths(outcome):
    certified, _, verdicts, _ = outcome
    assert certified == {
        "layout": ["api:n", "xpath:/p", "api:mm"],
        "cover": ["api:p", "api:q"],
        "weak": ["api:a.brand", "xpath:/marked"],
        "confirmed": ["api:l[page].v", "api:l[0].v"],
        "absent": ["api:q"],
        "default": ["api:p"],
        "volatile": ['xpath://a[@id="v-11.1.8"]'],
        "stable": ["api:p"],
        "unchecked": ["api:p"],
        "one_response": ["api:a", "api:dddd", "api:bb"],
    }
    assert {f: v.state for f, v in verdicts.items() if f not in certified} == {
        "lonely": "refused", "wrong": "refused", "elsewhere": "refused", "mismatch": "refused", "weakless": "refused", "unexpected": "refused",
        "nowhere": "not-on-website", "default_only": "default-only", "quoting": "refused", "missing": "incomplete", "bare": "refused",
    }


def test_cells(outcome):
    _, cells, _, _ = outcome
    ok = {"1": "pass", "2": "pass", "3": "pass"}
    assert cells["layout"] == cells["cover"] == cells["absent"] == cells["default"] == ok
    assert cells["lonely"] == {"1": "elsewhere", "2": "elsewhere"}
    assert cells["wrong"] == {"1": "ambiguous", "2": "ambiguous", "3": "different_value"}
    assert cells["elsewhere"] == {"1": "pass", "2": "pass", "3": "elsewhere"}
    assert cells["mismatch"] == {"1": "ambiguous", "2": "ambiguous", "3": "type_mismatch"}
    assert cells["weakless"] == {"1": "no_fitting_path", "2": "no_fitting_path"}
    assert cells["unexpected"] == {"1": "ambiguous", "2": "ambiguous", "3": "found_unexpected"}
    assert cells["nowhere"] == cells["default_only"] == {"1": "pass", "2": "pass"}
    assert cells["missing"] == {"1": "pass", "2": "not_captured", "3": "pass"}
    assert cells["unchecked"] == {"1": "pass", "2": "pass"}
    assert cells["bare"] == {"1": "not_found"}


def test_evidence_and_near_misses(outcome):
    _, _, verdicts, results = outcome
    assert [f for f, v in verdicts.items() if v.weak_evidence] == ["weak", "default_only"]
    assert [f for f, v in verdicts.items() if v.thin_evidence] == ["cover"]
    assert [f for f, v in verdicts.items() if v.volatile] == ["volatile"]
    near = {r.field: r.near_misses for r in results.where("url = '3' AND status = 'fail' AND field = 'wrong'").collect()}
    assert near == {"wrong": ["z", "y"]}


def test_fixed_twins(spark):
    pairs = [("offers[page].price", "offers[0].price", True), ("a[page].b[1]", "a[7].b[1]", True), ("a[page].b[1]", "a[7].b[2]", False), ("a.b", "a.b", False), ("a[page]", "a[x]", False), ("a.c[page]", "abc[1]", False)]
    frame = spark.createDataFrame(pairs, "p string, q string, want boolean")
    assert frame.where(is_fixed_twin(F.col("p"), F.col("q")) != F.col("want")).count() == 0


@pytest.mark.parametrize("name", ["certified_fields", "certified_cells"])
def test_orders_are_numbered_once(spark, sf_dir, name):
    """What the queries join last comes from stored proof pages, not from the orders again."""
    from skein.plans import certification

    files = certification.QUERIES[name][0](spark, sf_dir).inputFiles()
    assert files and not [f for f in files if f.endswith("/orders.parquet")]


def test_a_cover_of_more_pages_than_a_long_has_bits(spark):
    """The page that only the second path reads is the 66th."""
    values = [f"v{n}" for n in range(70)]
    pages = {str(n): v for n, v in enumerate(values)}
    first = [None if n == 65 else v for n, v in enumerate(values)]
    certified, cells, verdicts, _ = run(spark, {"many": ("text", "x", None, pages, {"api:p": first, "api:q": [None] * 65 + values[65:67] + [None] * 3})})
    assert certified == {"many": ["api:p", "api:q"]} and verdicts["many"].state == "cover" and set(cells["many"].values()) == {"pass"}
