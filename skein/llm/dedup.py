"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Rows are refined in narrow form only (id, length, prefix hash); a text is hashed whole only in a group that
still has two or more rows after both cheap levels. Texts are equal when byte-identical; null counts as empty.
Of equal texts the row with the largest id stays, null ids last; of rows that also share the id exactly one is
kept. Texts of any length are hashed whole where they lie. Carried columns keep their names; names that the result
adds are refused. An empty table gives no rows. All groups are counted with map-side aggregation, and the joins back
carry no text; groups too large for a task are broadcast to their rows, so a third of all rows in one group stays where
it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import large_groups, meet_groups
from .storage import materialise

#: Characters that the prefix hash covers; the full hash always covers the whole text.
PREFIX_CHARS = 256
#: Rows (of 12 bytes) up to which the surviving keys are sent to every task instead of shuffled: under 10 MB.
BROADCAST_KEYS = 500_000
RESULT = ("doc_id", "keep_id", "group_size", "kept")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept and the columns named in ``carry``."""
    if clash := set(carry) & set(RESULT):
        raise ValueError(f"carried columns clash with the result's: {sorted(clash)}")
    # carried columns travel under names of their own, so that none meets those of the refinement
    held = {c: f"carried_{n}" for n, c in enumerate(carry)}
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        *[F.col(f"`{c}`").alias(name) for c, name in held.items()],
        F.octet_length(text).alias("length"),
        F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("prefix_hash"),
        text.alias("whole_text"),
    )
    narrow = materialise(keyed.drop("whole_text"), "dedup")

    # a group of copies shares its length: lengths are counted before any row moves, and rows then stay where they are
    by_length = materialise(narrow.groupBy("length").count().where("count > 1").select("length"), "dedup-lengths")
    few_lengths = F.broadcast(by_length) if by_length.count() <= BROADCAST_KEYS else by_length
    by_prefix = narrow.join(few_lengths, "length", "left_semi").groupBy("length", "prefix_hash").count().where("count > 1")
    survivors = materialise(by_prefix.select("length", "prefix_hash"), "dedup-keys")

    hashed = keyed.withColumn("full_hash", F.unhex(F.sha2("whole_text", 256)))
    if survivors.count() <= BROADCAST_KEYS:
        hashed = keyed.join(F.broadcast(survivors), ["length", "prefix_hash"], "left_semi").withColumn("full_hash", F.unhex(F.sha2("whole_text", 256)))
        hashed = hashed.drop("whole_text")
    else:
        hashed = hashed.drop("whole_text").join(survivors, ["length", "prefix_hash"], "left_semi")
    hashed = materialise(hashed.withColumn("row", F.monotonically_increasing_id()), "dedup-full")

    best = F.max(F.struct("doc_id", "row")).alias("best")
    groups = materialise(hashed.groupBy("full_hash").agg(best, F.count("*").alias("group_size")), "dedup-groups")
    # the largest groups are few whatever the corpus; they go to the rows instead of the rows to them
    matched = meet_groups(hashed, groups, large_groups(groups, "full_hash", "group_size"), "full_hash")
    out = ["doc_id", *[F.col(name).alias(c) for c, name in held.items()], "keep_id", "group_size", "kept"]
    decided = matched.withColumns({"keep_id": F.col("best.doc_id"), "kept": F.col("row") == F.col("best.row")}).select(*out)
    alone = narrow.join(survivors, ["length", "prefix_hash"], "left_anti")
    alone = alone.withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    return decided.unionByName(alone.select(*out))
