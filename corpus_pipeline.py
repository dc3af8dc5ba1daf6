"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing to weights, packing.

Each stage is (name, function of (spark, docs, sf_dir)); its result is stored as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skein.llm.dedup import exact_dedup
from skein.llm.mixing import mix_documents
from skein.llm.packing import pack_documents
from skein.llm.quality import keep_good, train
from skein.llm.rows import PLACE, keep_rows, numbered
from skein.llm.simhash import similar_representatives
from skein.llm.storage import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and that the trees find good. Null and empty texts fail; repeated rows pass or
    fail together; an empty table or one without usable labels leaves what passes the base rules."""
    return keep_good(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null is empty), the row with the largest doc_id, null ids last; of rows that share the id too, one.
    Rows are known by their place in the stored table, so texts are not moved; an empty table stays empty."""
    rows = numbered(docs)
    return keep_rows(rows, exact_dedup(rows, carry=PLACE).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by 0.8 or more of their five-word shingles in common, the row with the smallest doc_id, null ids
    last. Texts without words are one class; an empty table stays empty."""
    rows = numbered(docs)
    return keep_rows(rows, similar_representatives(rows))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated or cut to their share of words; the null source is one of its own, rows without words are kept
    once an epoch; an empty table stays empty."""
    return mix_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows of 2048, each with its sequence and offset. Null texts are their end token; ids come back as
    they are, as often as the mix repeats them; an empty table gives no pieces."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack", pack_windows),
]

#: The trees of the first stage are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored in the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/skein-stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
