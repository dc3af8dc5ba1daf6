"""Queries of the training-data operators over the driver's tables, and their DuckDB twins."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import attachment_part, format_chat, read_loss, read_turns, text_messages, text_part
from .dedup import exact_dedup
from .fim import fill_in_middle, restore
from . import lm_scoring
from .jaccard import jaccard_classes
from .mixing import mix_plan
from .packing import pack_documents
from .quality import judge_documents, train
from .secrets import find_secrets, seeded_findings, spans_text
from .secrets import fit as fit_secrets
from .sharding import shard_documents
from .simhash import simhash_classes
from .toxicity import score_documents
from .toxicity import train as train_toxicity
from .whitening import whiten


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(_documents(spark, sf_dir))


OP1_SQL = r"""
WITH base AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS source_key,
         md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mix_key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sources AS (SELECT source_key, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY 1),
weighed AS (
  SELECT *, CAST([3, 1, 2][1 + CAST((row_number() OVER (ORDER BY source_key) - 1) % 3 AS INTEGER)] AS DOUBLE) AS weight,
         2.0::DOUBLE * source_size AS cap FROM sources),
levels AS (
  SELECT *, cap / weight AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER ()
           - (sum(cap) OVER (ORDER BY cap / weight, source_key ROWS UNBOUNDED PRECEDING) - cap))
         / sum(weight) OVER (ORDER BY cap / weight, source_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT *, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * weight) END AS target
  FROM (SELECT *, max(CASE WHEN ratio > level THEN level END) OVER () AS final FROM levels)),
plan AS (
  SELECT source_key, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
         CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs
  FROM targets),
ordered AS (
  SELECT *, sum(size) OVER (PARTITION BY source_key ORDER BY mix_key, doc_id ROWS UNBOUNDED PRECEDING) - size AS before FROM base)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM ordered JOIN plan USING (source_key)
"""


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hostile = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), hostile.alias("text")
    )
    rows = rows.unionByName(extra)
    # every conversation twice: as it is, and with an attachment at the first blank of every turn
    text = F.coalesce("text", F.lit(""))
    head = F.substring_index(text, " ", 1)
    kinds = F.array(*map(F.lit, ("image", "audio", "document")))
    attachment = attachment_part(F.element_at(kinds, (F.pmod("turn", F.lit(3)) + 1).cast("int")), F.concat_ws("/", "conv_id", "turn"), F.length(text) % 5)
    parts = F.array(text_part(head), attachment, text_part(F.substr(text, F.length(head) + 1)))
    both = text_messages(rows).withColumn("typed", F.lit(False)).unionByName(rows.select("conv_id", "turn", "role", parts.alias("parts")).withColumn("typed", F.lit(True)))
    chats = format_chat(both.withColumn("conv_id", F.struct("conv_id", "typed")))
    chats = chats.withColumns({"turns": read_turns(F.col("formatted")), "loss": read_loss(F.col("formatted"), F.col("loss_spans"))})
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    # each placeholder read back in order, with what is recorded of its attachment
    marks = F.flatten(F.transform("turns", lambda t: t["marks"]))
    recorded = F.transform(F.arrays_zip(marks.alias("mark"), F.col("attachments")), lambda z: F.concat_ws(" ", z["mark"], z["attachments"]["uri"], z["attachments"]["tokens"].cast("string")))
    digests = chats.select(
        "conv_id.*",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        F.aggregate("attachments", F.lit(0).cast("long"), lambda total, a: total + a["tokens"]).alias("attachment_tokens"),
        F.sha2(F.array_join(recorded, "\n"), 256).alias("attachments_sha256"),
    )
    plain = [F.max(F.when(~F.col("typed"), F.col(c))).alias(c) for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")]
    typed = [F.max(F.when(F.col("typed"), F.col(c))).alias(n) for c, n in (("turns_sha256", "typed_turns_sha256"), ("formatted_chars", "typed_chars"))]
    typed += [F.max(F.when(F.col("typed"), F.col(c))).alias(c) for c in ("n_attachments", "attachment_tokens", "attachments_sha256")]
    return digests.groupBy("conv_id").agg(*plain, *typed)


OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, ['image', 'audio', 'document'][1 + ((turn % 3) + 3) % 3] AS kind, length(text) % 5 AS units,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS number,
         length(text) + len(regexp_extract_all(text, '[\[<]\\*(INST\]|/INST\]|s>|/s>|image:|audio:|document:)'))
           + CASE WHEN role = 'assistant' THEN 7 ELSE 14 + length(role) END AS chars
  FROM rows),
spoken AS (
  SELECT *, '<' || kind || ':' || number || '>' AS mark, CASE kind WHEN 'image' THEN 256 WHEN 'audio' THEN 25 ELSE 768 END * units AS tokens FROM marked)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS typed_turns_sha256,
       CAST(sum(chars + length(mark)) AS BIGINT) AS typed_chars,
       count(*) AS n_attachments, CAST(sum(tokens) AS BIGINT) AS attachment_tokens,
       sha256(string_agg(mark || ' ' || conv_id || '/' || turn || ' ' || tokens, chr(10) ORDER BY number)) AS attachments_sha256
FROM spoken GROUP BY conv_id
"""


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return exact_dedup(docs, carry=("text_sha256",))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = find_secrets(docs, fit_secrets(docs, seeded_findings()))
    base = found.withColumn("base", F.filter("findings", lambda f: f["kind"] != "model"))

    def number(kind):
        return F.size(F.filter("base", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in ("assign", "access", "hex")]
    return base.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("findings")).alias("spans"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(_documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return judge_documents(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(_documents(spark, sf_dir)).drop("class_print")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return score_documents(docs, train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(_documents(spark, sf_dir))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP12_SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS unit,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
hashed AS (
  SELECT *, len(unit) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM units),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed),
parts AS (
  SELECT *, array_to_string(unit[1:a], '') AS prefix, array_to_string(unit[a + 1:b], '') AS middle, array_to_string(unit[b + 1:], '') AS suffix
  FROM formed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_documents(spark, sf_dir))


def queries():
    return {
        "op1_mix": op1_mix,
        "op2_chat": op2_chat,
        "op3_pack": op3_pack,
        "op4_shard": op4_shard,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_secrets": op6_secrets,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_quality": op8_quality,
        "op9_simhash": op9_simhash,
        "op10_toxicity": op10_toxicity,
        "op11_whitening": op11_whitening,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_jaccard": op13_jaccard,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    found = {"op1_mix": OP1_SQL, "op2_chat": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op12_fill_in_middle": OP12_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
