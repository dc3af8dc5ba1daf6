"""The extraction chain against a plain walk over the tiers."""

import random

import pytest

from skein.operators import chain as C

FIELDS = [("title", "string", False), ("price", "number", False), ("link", "string", True)]
TEXT = "The red steel kettle holds two litres"


def usable(row, scoped):
    field, tier, source, value = row["field"], row["tier"], row["source"], row["value"]
    if value is None or scoped and source != "xpath":
        return False
    if field == "price":
        return value.replace("$", "").replace(",", "").strip().replace(".", "", 1).isdigit()
    if value.strip() == "" or value.strip().lower() == "reviews":
        return False
    if field == "title" and source in ("api", "api-ai"):
        words = [w for w in value.lower().split(" ") if len(w) > 2]
        return not words or sum(w in TEXT.lower() for w in words) / len(words) >= 0.6
    return True


def walk(rows, scoped):
    """Tier of the value, and the stored paths that are charged, asking one candidate after another."""
    held, charged = None, []
    for row in sorted(rows, key=lambda r: (list(C.TIERS).index(r["tier"]), r["place"])):
        over = row["tier"] == "override"
        if held and not (over and held["tier"] not in ("selected", "displayed", "override")):
            continue
        if usable(row, scoped):
            held = row
        elif row["tier"] in C.STORED and not scoped:
            charged.append(row["path"])
    return held, charged


@pytest.mark.parametrize("seed", range(3))
def test_chain_is_the_walk(spark, seed):
    rng = random.Random(seed)
    values = {"title": ["Red kettle", "Blue teapot lid", "Reviews", " ", None, "an ox", "The steel kettle"], "price": ["$12.5", "ask", None, "1,200"], "link": ["/a", None, "/b"]}
    rows = []
    for k in range(120):
        for field in values:
            for tier in rng.sample(list(C.TIERS), rng.randint(1, 6)):
                for place in range(rng.randint(1, 2)):
                    source = "xpath" if tier in ("override", "xpath") else rng.choice(["api", "json-ld", "api-ai", "xpath"])
                    rows.append({"k": k, "field": field, "tier": tier, "source": source, "path": f"{tier}.{place}", "place": place, "confidence": 0.4, "value": rng.choice(values[field])})
    candidates = spark.createDataFrame(rows, "k long, field string, tier string, source string, path string, place int, confidence double, value string")
    pages = spark.createDataFrame([(k, TEXT if k % 10 else None) for k in range(120)], "k long, page_text string")
    rows = [r for r in rows if r["k"] % 10]  # pages without a text corroborate anything: not walked here
    told = C.decide(C.judged(candidates, spark.createDataFrame(FIELDS, "field string, type string, row_scoped boolean"), pages, ["k"]), ["k"]).where("k % 10 <> 0")
    groups = {}
    for r in rows:
        groups.setdefault((r["k"], r["field"]), []).append(r)
    want = {g: walk(rs, g[1] == "link") for g, rs in groups.items()}
    got = {(r.k, r.field): (r.tier, r.path) for r in C.chain_values(told, ["k"]).collect()}
    assert got == {g: (h["tier"], h["path"]) for g, (h, _) in want.items() if h}
    seen = C.chain_observations(told, ["k"]).collect()
    assert sorted((r.k, r.field, r.path) for r in seen if not r.hit) == sorted((*g, p) for g, (_, ps) in want.items() for p in ps)
    assert sum(r.hit for r in seen) == len(got)
    assert told.count() == len(rows)


def test_values_without_a_text_stand(spark):
    row = [(1, "title", "mechanical", "api", "t", 0, 0.4, "Blue teapot lid")]
    candidates = spark.createDataFrame(row, "k long, field string, tier string, source string, path string, place int, confidence double, value string")
    fields = spark.createDataFrame(FIELDS, "field string, type string, row_scoped boolean")
    for text in (None, "", TEXT):
        pages = spark.createDataFrame([(1, text)], "k long, page_text string")
        values = C.chain_values(C.decide(C.judged(candidates, fields, pages, ["k"]), ["k"]), ["k"]).collect()
        assert [(v.value, v.confidence) for v in values] == ([] if text == TEXT else [("Blue teapot lid", 0.8)])
