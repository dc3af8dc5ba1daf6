"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within a source, documents are taken in key order until the source's
budget of words is met; a budget above the source's size repeats whole epochs first. The cut needs no sort of
the corpus: keys fall into about sqrt(rows) ranges per source, ranges get a prefix sum of their word counts,
and only the range that holds the cut is sorted. What leaves is one cut per source, so the documents themselves
are never shuffled: each row compares its key with its source's cut.

Defined results: texts of any length are counted whole; null text has size 0; null source is a source of its own and sorts last; a null id hashes as
''; rows with equal ids share a key and split what is left at the cut evenly; an empty table gives no rows.
Columns that clash with the added ones are replaced in ``mix_plan`` and untouched in ``mix_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.operators.relational import small

from .storage import materialise
from .words import count_words


@dataclass(frozen=True)
class MixSpec:
    """``weights`` repeat over the sources in code-point order; all sources share ``volume`` times all sizes;
    no source gives more than ``most`` times its own size."""

    weights: tuple[int, ...] = (3, 1, 2)
    volume: float = 1.5
    most: int = 2
    seed: int = 42


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), source))


def _mix_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _range_of(key: Column, ranges: Column) -> Column:
    """Order-preserving range number of a hexadecimal key: its first 32 bits scaled to ``ranges``."""
    head = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    return F.shiftright(head * ranges, 32)


def source_targets(sizes: DataFrame, spec: MixSpec) -> DataFrame:
    """One row per source: source_size, rows, target. ``sizes`` has columns source_key and size.

    Targets fill by weight up to ``most`` times the source; sorted by cap over weight, the common level is
    what remains after the capped sources divided by the weight that remains. The windows run over one row a
    source: 20 or 20,000 rows, not documents.
    """
    per_source = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    weights = F.array(*[F.lit(float(w)) for w in spec.weights])
    everything = W.partitionBy(F.lit(0))
    ranked = (
        per_source.withColumn("rank", F.row_number().over(everything.orderBy("source_key")) - 1)
        .withColumn("weight", F.element_at(weights, (F.col("rank") % len(spec.weights)).cast("int") + 1))
        .withColumn("cap", F.col("source_size").cast("double") * spec.most)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    by_ratio = everything.orderBy("ratio", "source_key")
    total = F.sum("source_size").over(everything).cast("double") * spec.volume
    filled = F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, 0)) - F.col("cap")
    left = F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    levelled = ranked.withColumn("level", (total - filled) / left).withColumn(
        "final", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything)
    )
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight")))
    return levelled.select("source_key", "source_size", "rows", target.alias("target"))


def source_cuts(narrow: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: epochs taken whole, and the key at which the last, partial epoch ends with what is left there."""
    budget = F.floor(F.col("target") + 0.5).cast("long")
    plan = (
        targets.withColumn("budget", budget)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .withColumn("ranges", F.ceil(F.sqrt(F.col("rows").cast("double"))).cast("long"))
    )
    ranged = narrow.join(plan.select("source_key", "ranges", "rest"), "source_key").withColumn("range", _range_of(F.col("mix_key"), F.col("ranges")))
    sums = ranged.groupBy("source_key", "range").agg(F.sum("size").alias("range_size"), F.first("rest").alias("rest"))
    upto = W.partitionBy("source_key").orderBy("range").rowsBetween(W.unboundedPreceding, 0)
    holds = (
        sums.withColumn("range_before", F.sum("range_size").over(upto) - F.col("range_size"))
        .where((F.col("range_before") < F.col("rest")) & (F.col("rest") <= F.col("range_before") + F.col("range_size")))
        .select("source_key", "range", "range_before")
    )
    inside = ranged.join(holds, ["source_key", "range"]).groupBy("source_key", "mix_key", "rest", "range_before").agg(
        F.sum("size").alias("key_size"), F.count("*").alias("copies")
    )
    in_order = W.partitionBy("source_key").orderBy("mix_key").rowsBetween(W.unboundedPreceding, 0)
    cut = (
        inside.withColumn("before", F.col("range_before") + F.sum("key_size").over(in_order) - F.col("key_size"))
        .where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("key_size")))
        .select("source_key", F.col("mix_key").alias("cut_key"), F.floor((F.col("rest") - F.col("before")) / F.col("copies")).alias("cut_words"))
    )
    return plan.select("source_key", "source_size", "target", "epochs").join(cut, "source_key", "left")


def _taken() -> Column:
    partial = (
        F.when(F.col("mix_key") < F.col("cut_key"), F.col("size"))
        .when(F.col("mix_key") == F.col("cut_key"), F.least("size", "cut_words"))
        .otherwise(F.lit(0))
    )
    return F.col("epochs") * F.col("size") + partial


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str, spec: MixSpec) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        _source_key(F.col(source_col)).alias("source_key"),
        _mix_key(F.col(id_col), spec.seed).alias("mix_key"),
        count_words(F.col(text_col)).alias("size"),
    )


def mix_plan(docs: DataFrame, spec: MixSpec = MixSpec(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target and the words the mix takes of it."""
    narrow = materialise(_narrow(docs, id_col, text_col, source_col, spec), "mix")
    cuts = materialise(source_cuts(narrow, source_targets(narrow, spec)), "mix-cuts")
    return narrow.join(small(cuts), "source_key").select("doc_id", "size", "source_size", "target", _taken().alias("taken"))


def mix_documents(docs: DataFrame, spec: MixSpec = MixSpec(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself with the columns of ``docs``: a row for each epoch that takes a document, the one at a
    source's cut shortened to the words taken. Rows without words are in each whole epoch, at least once."""
    narrow = materialise(_narrow(docs, id_col, text_col, source_col, spec), "mix")
    cuts = materialise(source_cuts(narrow, source_targets(narrow, spec)), "mix-cuts")
    own = docs.columns
    inner = F.struct(*[F.col(f"`{c}`") for c in own]).alias("doc")
    keyed = docs.select(
        inner,
        _source_key(F.col(source_col)).alias("source_key"),
        _mix_key(F.col(id_col), spec.seed).alias("mix_key"),
        count_words(F.col(text_col)).alias("size"),
    ).join(small(cuts), "source_key")
    taken = keyed.withColumn("taken", _taken()).withColumn("part", F.col("taken") - F.col("epochs") * F.col("size"))
    whole = F.array_repeat(F.lit(None).cast("long"), F.greatest(F.col("epochs"), F.when(F.col("size") == 0, 1).otherwise(0)).cast("int"))
    parts = F.when(F.col("part") <= 0, whole).otherwise(F.concat(whole, F.array(F.when(F.col("part") < F.col("size"), F.col("part")))))
    copies = taken.select("doc", F.explode(parts).alias("words"))
    first_words = F.array_join(F.slice(F.regexp_extract_all(F.col(f"doc.`{text_col}`"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("words").cast("int")), "")
    text = F.when(F.col("words").isNull(), F.col(f"doc.`{text_col}`")).otherwise(first_words)
    return copies.select(*[(text if c == text_col else F.col(f"doc.`{c}`")).alias(c) for c in own])
