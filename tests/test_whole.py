"""Queries over all of their input: keys beyond any fixed bound, against the registered SQL."""

import duckdb
import pytest

from skein.plans import catalogue
from tests.compare import rows

#: Keys far from zero; of users with odd numbers only done and failed jobs, so that they get new ones.
FAR = {
    "lineitem": "* REPLACE (l_orderkey + 100000 AS l_orderkey, l_partkey + 100000 AS l_partkey)",
    "orders": "* REPLACE (o_orderkey + 100000 AS o_orderkey)",
    "customer": "* REPLACE (c_custkey + 100000 AS c_custkey)",
    "supplier": "*",
    "events": "* REPLACE (event_id + 100000 AS event_id)",
}


@pytest.fixture(scope="module")
def far(sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("far"))
    with duckdb.connect() as con:
        con.execute("SET TimeZone = 'UTC'")
        for name, columns in FAR.items():
            only = "WHERE user_id % 2 = 0 OR event_id % 4 >= 2" if name == "events" else ""
            con.execute(f"COPY (SELECT {columns} FROM '{sf_dir}/{name}.parquet' {only}) TO '{folder}/{name}.parquet'")
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
        yield folder, con


PATHS = ["ranked_paths", "pruned_paths", "verified_paths", "spread_paths"]
VARIANTS = ["variant_rows", "variant_summary", "nested_rows", "variant_documents"]


@pytest.mark.parametrize("name", [*PATHS, *VARIANTS, "certified_values", "certify_layout", "enqueued", "due_sweep", "insert_missing"])
def test_keys_beyond_any_bound_are_read(spark, far, name):
    folder, con = far
    sql = catalogue.oracle_sql()[name]
    got = catalogue.queries()[name](spark, folder).toPandas()
    want = con.execute(sql).fetchdf()
    assert len(want)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


#: url, words' score with the added path (product words 4, api words 2, related words -30), pairs with the added one if page_id % 3 = 0
ADDRESSES = [
    ("https://x.example/en/1", -20, "color=Red&size=M"),
    ("https://x.example/item/1?page=2&ref=x", -16, ""),
    ("https://x.example/en/1#top", -20, ""),
    ("https://x.example/v2/1?style=9&page=2#top", -18, "color=Red&size=M&style=9"),
    ("https://x.example/similar/1?product=1#fit=slim", -50, "fit=slim&product=1"),
    ("https://x.example?style=9#fit=slim&cut=a", -20, "cut=a&fit=slim&style=9"),
    ("https://x.example/en#fit=slim?x", -20, "color=Red&fit=slim?x&size=M"),
]


def test_words_and_pairs_of_addresses_with_query_and_fragment(spark, tmp_path):
    pages = [(n, url) for n, (url, *_) in enumerate(ADDRESSES)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    score = {r.page_id: r.score for r in catalogue.queries()["request_words"](spark, str(tmp_path)).collect()}
    assert score == {n: s for n, (_, s, _) in enumerate(ADDRESSES)}
    pairs = {r.page_id: r.pairs for r in catalogue.queries()["variant_pairs"](spark, str(tmp_path)).collect()}
    assert pairs == {n: p for n, (_, _, p) in enumerate(ADDRESSES)}


def test_corroboration_takes_the_whole_passage(spark, sf_dir, tmp_path):
    """Against every passage and text in Python, with texts that hold a passage's end, words with marks and a very long word."""
    words = [f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta") for b in "mnopqrst"]
    passages = [(n, " ".join(words[n : n + 20])) for n in range(5)] + [(9, "of a"), (10, "Of alpham Alpham of betan")]
    texts = [" ".join(words[2:22]), " ".join(words[9:24]), ", ".join(words[:14]), "".join(words[:12]), " ".join(words[1:22:2]), "alpham betan!", "of", None, ""]
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def brute(docs, items):
        for d, text in docs:
            seen = " ".join((text or "").lower().split())
            for i, passage in items:
                tokens = [w for w in passage.lower().split() if len(w) >= 3]
                share = sum(w in seen for w in tokens) / len(tokens) if tokens else 0
                if share >= 0.6:
                    yield d, i, round(share, 9)

    found = lambda folder: sorted((r.doc_id, r.item_id, round(r.share, 9)) for r in catalogue.queries()["corroboration"](spark, folder).collect())
    want = sorted(brute(enumerate(texts), passages))
    assert {d for d, *_ in want} >= {0, 1, 2, 3, 5} and found(str(tmp_path)) == want
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = sorted(brute(docs, items))
    assert want and found(sf_dir) == want


def test_corroboration_reads_each_text_once_where_it_lies(spark, tmp_path, monkeypatch):
    """No exchange of texts, words or pairs; words longer than ``LONGEST`` and what is forgotten in between change nothing."""
    from skein.plans import values

    monkeypatch.setattr(values, "KEPT_WORDS", 3)
    passages = [(1, "abc abcd abc bcdefg zzz"), (2, "abcd éa xyz x")]
    texts = ["q" * 400 + "abcdefg", "xyz abc", "abcdé bcdefg " * 3, "abc zzz zbcdz", "ab cd", None]
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = values.corroboration(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [(0, 1, 0.8), (2, 1, 0.8), (3, 1, 0.6)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
