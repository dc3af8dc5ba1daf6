"""Focus windows against a plain scan of each page, and pages without signals."""

import random
import re

import pytest
from pyspark.sql import functions as F

from skein.operators import focus as O

MOST = 1200


def densest(places, width):
    places = sorted(places)
    return max(places, key=lambda p: (sum(p <= q <= p + width for q in places), -p))


def cluster(places, width):
    """start, inside, score; None for fewer than five points in the densest stretch."""
    start = densest(places, width)
    inside = sorted(p for p in places if start <= p < start + width)
    if len(inside) < 5:
        return None
    gaps = sorted(b - a for a, b in zip(inside, inside[1:]))
    share = max(0, min(1, (gaps[len(gaps) // 2] - 300) / 2700))
    return start, len(inside), 0.55 * share + 0.25 * (min(len(inside), 12) / 12) + 0.2 * min(1, (inside[-1] - inside[0]) / width)


def plain(html, most):
    """strategy and index of a page without landmarks, results attributes and filters."""
    if len(html) <= most:
        return "whole-document", 0
    signals = []
    at = lambda pattern: [m.start() for m in re.finditer(pattern, html, re.I)]
    classes = {}
    for m in re.finditer(r'class="([^"]{1,200})"', html):
        for token in m[1].split(" "):
            if 3 <= len(token) <= 40:
                classes.setdefault(token, []).append(m.start())
    found = [(c[2] + (0.05 if re.search(O.TILE_WORDS, t) else 0), c[0]) for t, p in classes.items() if (c := cluster(p, most))]
    if found:
        raw, start = max(found, key=lambda f: f[0])
        signals.append((min(0.9, raw), "repeated-class", start))
    shapes = {}
    for m in re.finditer(r'<a\b[^>]*href="([^"]+)"', html, re.I):
        shape = re.sub(r"[a-z0-9]{12,}", "*", re.sub(r"\d+", "#", re.split("[?#]", m[1])[0]), flags=re.I)
        if len(shape) > 1:
            shapes.setdefault(shape, []).append(m.start())
    found = [(c[2], c[0]) for p in shapes.values() if (c := cluster(p, most))]
    if found:
        raw, start = max(found, key=lambda f: f[0])
        signals.append((min(0.88, raw), "link-shape", start))
    found = [(c[2] * w, c[0]) for tag, w in O.REPEATED.items() if (p := at(rf"<{tag}\b")) and (c := cluster(p, most))]
    if found:
        raw, start = max(found, key=lambda f: f[0])
        signals.append((raw, "semantic-repeat", start))
    for pattern, least, name, worth in ((O.LINKS, 10, "link-density", lambda n: min(0.75, 0.3 + n / 120)), (O.IMAGES, 8, "image-cluster", lambda n: min(0.6, 0.25 + n / 100))):
        places = [m.start() for m in re.finditer(pattern, html)]
        if places:
            start = densest(places, most)
            n = sum(start <= p < start + most for p in places)
            if n >= least:
                signals.append((worth(n), name, start))
    if not signals:
        return "head-of-document", 0
    _, name, start = max(signals, key=lambda s: s[0])
    return name, max(0, start - min(2000, most // 20))


def page(rng):
    pieces = ['<div class="card xy">', "<ARTICLE>", "<li>", '<a href="/p/{n}?x">', '<a href="/menu">', '<a class="tile tile" href="/q/abcdefghijkl{n}">', '<img src="/i{n}">', "<tr>", "é text "]
    kinds = rng.sample(pieces, rng.randint(1, 4))
    return "".join(rng.choice(kinds).format(n=rng.randint(1, 99)) + "w " * rng.randint(0, rng.choice([5, 60, 300])) for _ in range(rng.randint(0, 40)))


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(5)
    return [(n, page(rng)) for n in range(150)] + [(900, ""), (901, None), (902, "x" * 5000)]


def test_points_are_those_of_a_plain_scan(spark, pages):
    got = {r.k: (r.strategy, r["index"]) for r in O.focus_points(spark.createDataFrame(pages, "k long, html string"), ["k"], MOST).collect()}
    want = {k: plain(html or "", MOST) for k, html in pages}
    assert got == want
    assert {"link-shape", "link-density", "semantic-repeat", "repeated-class", "image-cluster", "head-of-document", "whole-document"} <= {s for s, _ in want.values()}


def test_text_starts_at_a_tag_and_ends_with_one(spark, pages):
    texts = {r.k: r for r in O.focus_windows(spark.createDataFrame(pages, "k long, html string"), ["k"], MOST).collect()}
    assert len(texts) == len(pages)
    for k, html in pages:
        html, row = html or "", texts[k]
        assert row.text in html and len(row.text) <= MOST
        if row.strategy == "whole-document":
            assert row.text == html
        elif row["index"]:
            assert row.text.startswith("<") or "<" not in html[row["index"] :]
    assert texts[902].text == "x" * MOST


@pytest.mark.parametrize(
    ("landmark", "strategy", "index"),
    [
        ("Featured Items", "landmark", 2000),  # stands once
        ("w w", "results-attribute", 1000),  # stands often: worth less than the attribute
        ("featured, items (12 of 40)", "results-attribute", 1000),  # two of its words: worth less than the attribute
        ("absent words here", "results-attribute", 1000),
        ("ab", "results-attribute", 1000),
        (None, "results-attribute", 1000),
    ],
)
def test_single_signals(spark, landmark, strategy, index):
    html = ("w " * 500 + '<ul id="search-results">').ljust(2000, "w") + "Featured Items" + "w " * 500
    index += {1000: 4}.get(index, 0)  # behind "<ul "
    got = O.focus_points(spark.createDataFrame([(1, html, landmark)], "k long, html string, mark string"), ["k"], 1000, landmark="mark").first()
    assert (got.strategy, got["index"]) == (strategy, index - 50)


def test_words_of_a_landmark(spark):
    html = "w " * 1000 + "Featured</> - Items" + "w " * 500
    got = O.focus_points(spark.createDataFrame([(1, html, "featured, items (12 of 40)")], "k long, html string, mark string"), ["k"], 1000, landmark="mark").first()
    assert (got.strategy, got["index"]) == ("landmark", 1950)


def test_addresses_by_form(spark):
    forms = {"/p/12": "/p/#", "https://x.example/a/abcdefghijklm?q#f": "/a/*", "//h.example": "/", "../a": "/a", "b/c": "/b/c", "#top": "/", "mailto:x@y": "x@y"}
    rows = spark.createDataFrame([(k,) for k in forms], "h string").select("h", O.link_form(F.col("h")).alias("f")).collect()
    assert {r.h: r.f for r in rows} == forms
