"""Rows of stored tables by place, and groups of rows met without moving a large group to one task."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise

#: Where a row lies in its stored table: a hash of the file's path, and the row's number in the file.
FILE, ROW = "skein_file", "skein_row"
PLACE = (FILE, ROW)
#: Bitmaps (of 4 KB, for 32,768 rows of a file each) that are sent to every task; beyond that rows meet by a shuffle.
MOST_BITMAPS = 8_000
#: Groups above this size, and above this share of all rows (so at most 20,000 groups), are sent to their rows rather
#: than joined by a shuffle on their key.
LARGE_GROUP, LARGE_GROUPS = 1000, 20_000


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``PLACE``. A table that is not read from Parquet is stored first."""
    try:
        return docs.select("*", F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
    except AnalysisException:
        return numbered(materialise(docs, "rows"))


def keep_rows(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The ``numbered`` rows whose places are in ``kept``, without the columns of ``PLACE``. Kept places become bitmaps, a bit a
    row, so that the rows and their texts stay where they are."""
    bits = kept.groupBy(FILE, F.bitmap_bucket_number(ROW).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(ROW)).alias("bits"))
    bits = materialise(bits.withColumnsRenamed({"bucket": "skein_bucket", "bits": "skein_bits"}), "kept")
    own = [F.col(f"`{c}`") for c in rows.columns if c not in PLACE]
    if bits.count() > MOST_BITMAPS:
        return rows.join(kept.select(*PLACE), list(PLACE), "left_semi").select(*own)
    met = rows.withColumn("skein_bucket", F.bitmap_bucket_number(ROW)).join(F.broadcast(bits), [FILE, "skein_bucket"])
    at = F.bitmap_bit_position(ROW)
    byte = F.conv(F.hex(F.substr("skein_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, at % 8) == 1).select(*own)


def large_groups(groups: DataFrame, key: str, size: str) -> DataFrame:
    """Keys of the groups (stored, one row a key) that are too large for a task; few, whatever the table."""
    rows = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return groups.where(F.col(size) > max(LARGE_GROUP, rows // LARGE_GROUPS)).select(key)


def meet_groups(rows: DataFrame, groups: DataFrame, large: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of their group. The groups of the keys ``large`` (see ``large_groups``) go to the rows,
    which stay where they are; other rows and groups meet by a shuffle."""
    hot = F.broadcast(large)
    cold = rows.join(hot, key, "left_anti").join(groups.join(hot, key, "left_anti"), key)
    return rows.join(F.broadcast(groups.join(hot, key, "left_semi")), key).unionByName(cold)
