"""Archives: what is written is read again; foreign records, cut records, other encodings."""

from pyspark.sql import functions as F

from skein.sources import warc


def at():
    return F.timestamp_seconds(F.lit(1_700_000_000))


def test_round_trip(spark, tmp_path):
    pages = [("https://a.example/1", "<p>é\r\n\r\nb</p>\r\n"), ("https://a.example/2", ""), ("https://a.example/3", None), (None, "lost"), ("https://a.example/ü", "WARC/1.0\r\n"[1:] + "x" * 300_000)]
    df = spark.createDataFrame(pages, "url string, html string").repartition(3)
    warc.write_warc(df, str(tmp_path / "w"), at())
    got = {r.url: r for r in warc.responses(spark, str(tmp_path / "w")).collect()}
    assert {u: r.html for u, r in got.items()} == {u: h or "" for u, h in pages if u}
    assert {r.status for r in got.values()} == {200}


def test_a_record_cut_by_its_own_text_is_told(spark, tmp_path):
    pages = spark.createDataFrame([("https://a.example/1", "WARC/1.0\r\nx"), ("https://a.example/2", "y")], "url string, html string")
    warc.write_warc(pages.coalesce(1), str(tmp_path / "w"), at())
    assert sorted((r.url, r.whole) for r in warc.records(spark, str(tmp_path / "w")).collect()) == [("https://a.example/1", False), ("https://a.example/2", True)]


def test_splits_lose_no_record(spark, tmp_path):
    pages = spark.range(300).select(F.concat(F.lit("https://a.example/"), "id").alias("url"), F.repeat(F.lit("ab\r\n"), (F.col("id") * 7 % 900).cast("int")).alias("html"))
    warc.write_warc(pages.coalesce(1), str(tmp_path / "w"), at())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        read = warc.responses(spark, str(tmp_path / "w"))
        assert read.rdd.getNumPartitions() > 10
        assert read.join(pages, ["url", "html"]).count() == read.count() == 300
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_foreign_records(spark, tmp_path):
    body = "<p>é</p>".encode("latin-1")
    http = b"HTTP/1.1 301 Moved\r\ncontent-type: text/html; charset=ISO-8859-1\r\nSet-Cookie: a\r\nSet-Cookie: b\r\n\r\n" + body
    record = lambda kind, block, length: (f"WARC/1.1\r\nWARC-Type: {kind}\r\nwarc-target-uri: https://b.example\r\nContent-Length: {length}\r\n\r\n").encode() + block + b"\r\n\r\n"
    data = record("warcinfo", b"software: x", 11) + record("response", http, len(http)) + record("response", http[:-3], len(http)) + b"WARC/1.1\r\nno record"
    (tmp_path / "x.warc").write_bytes(data)
    found = warc.records(spark, str(tmp_path), "1.1").orderBy("kind", "whole").collect()
    assert [(r.kind, r.whole) for r in found] == [("response", False), ("response", True), ("warcinfo", True)]
    assert [(r.url, r.status, r.html) for r in warc.responses(spark, str(tmp_path), "1.1").collect()] == [("https://b.example", 301, "<p>é</p>")]
