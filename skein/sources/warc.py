"""Web archive files: records read and written by Spark's text source, cut at the line that starts a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

END = "\r\n\r\n"


def _header(lines: Column, name: str) -> Column:
    """Value of the first header of that name, in any case of letters."""
    own = F.filter(lines, lambda x: F.startswith(F.lower(x), F.lit(f"{name.lower()}:")))
    return F.trim(F.substr(F.try_element_at(own, F.lit(1)), F.lit(len(name) + 2)))


def _parted(block: Column) -> tuple[Column, Column]:
    """Header lines and all behind the first empty line."""
    head = F.substring_index(block, END, 1)
    return F.split(head, "\r\n"), F.substr(block, F.length(head) + len(END) + 1)


def records(spark: SparkSession, path: str, version: str = "1.0") -> DataFrame:
    """Records of uncompressed archives: file, kind, url, at, id, length (declared bytes), whole (all bytes are there), block.

    A record ends where the next one's first line stands, so files are split over tasks like text, and only the columns
    asked for are made. A block that holds that line itself is cut there; it is not ``whole``. Text without a declared
    length or kind is no record.
    """
    lines = spark.read.option("lineSep", f"{END}WARC/{version}\r\n").text(path)
    # Latin-1 keeps a byte a character: places in the text are places in the bytes, whatever encoding a page has
    bare = lines.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), rf"^\s*WARC/{version}\r\n", "").alias("value"))
    headers, block = _parted(F.col("value"))
    utf8 = lambda text: F.encode(text, "ISO-8859-1").cast("string")
    told = bare.select(
        "file",
        _header(headers, "WARC-Type").alias("kind"),
        utf8(_header(headers, "WARC-Target-URI")).alias("url"),
        _header(headers, "WARC-Record-ID").alias("id"),
        _header(headers, "WARC-Date").try_cast("timestamp").alias("at"),
        _header(headers, "Content-Length").try_cast("long").alias("length"),
        F.encode(block, "ISO-8859-1").alias("block"),
    )
    own = told.where("kind IS NOT NULL AND length IS NOT NULL")
    # the last record of a file still has its end mark
    return own.withColumn("whole", F.octet_length("block") >= F.col("length")).withColumn("block", F.expr("substring(block, 1, CAST(length AS INT))"))


def responses(spark: SparkSession, path: str, version: str = "1.0") -> DataFrame:
    """Whole HTTP responses of archives: url, at, status, content_type, html (Latin-1 where declared, else UTF-8)."""
    got = records(spark, path, version).where("kind = 'response' AND whole")
    headers, body = _parted(F.decode("block", "ISO-8859-1"))
    kind = _header(headers, "Content-Type")
    latin = F.lower(kind).rlike(r"charset=\"?(?:iso-8859-1|latin-?1|windows-1252|us-ascii)")
    html = F.when(F.coalesce(latin, F.lit(False)), body).otherwise(F.encode(body, "ISO-8859-1").cast("string"))
    status = F.regexp_extract(F.element_at(headers, 1), r"^HTTP/\S+ (\d{3})", 1).try_cast("int")
    return got.select("url", "at", status.alias("status"), kind.alias("content_type"), html.alias("html"))


def write_warc(pages: DataFrame, path: str, at: Column, status: Column | None = None) -> None:
    """Pages (url, html) as response records, a file a task. Null pages are empty; rows without an address are left out."""
    body = F.coalesce("html", F.lit(""))
    code = F.lit(200) if status is None else status
    block = F.concat(F.lit("HTTP/1.1 "), code.cast("string"), F.lit("\r\nContent-Type: text/html; charset=utf-8" + END), body)
    digest = F.sha2(F.concat_ws("\n", "url", at.cast("string")), 256)
    ident = F.concat_ws("-", *[F.substr(digest, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    parts = [
        "WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: ", F.col("url"), "\r\nWARC-Date: ", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "\r\nWARC-Record-ID: <urn:uuid:", ident, ">\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: ", F.octet_length(block).cast("string"), END, block,
    ]
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    pages.where("url IS NOT NULL").select(text.alias("value")).write.option("lineSep", END).text(path)
