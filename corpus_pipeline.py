"""From raw documents to packed training sequences: five stages, each on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.llm import langid, line_dedup, packing, quality, simhash
from tallymill.llm.common import free_name, stored

#: A document whose words speak less than this for its best language is in none that was learnt.
MIN_LANGUAGE_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that are in no language learnt."""
    model = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))).select("doc_id", "lang", "text"))
    name = free_name(docs, "_lang")
    known = (F.col(f"{name}.lang") != langid.UNKNOWN) & (F.col(f"{name}.score") >= MIN_LANGUAGE_SCORE)
    return langid.predictions(docs, model, name=name).filter(known).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail a rule of the current policy."""
    name = free_name(docs, "_ledger")
    kept = quality.verdict(F.col(f"{name}.failed"), "base") & quality.verdict(F.col(f"{name}.failed"))
    return quality.ledger(docs, name=name).filter(kept).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; no document goes."""
    cleaned = line_dedup.dedup_lines(docs).select(*docs.columns)
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else cleaned


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near-duplicates.

    Rows without a doc_id cannot be named and stay; of rows that share the doc_id that stays, all stay.
    """
    groups = simhash.simhash_groups(docs)
    name = free_name(docs, "_gone")
    gone = groups.filter("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(stored(gone, "near-duplicates"), F.col("doc_id") == F.col(name), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all kept documents into sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("line_dedup", dedup_lines),
          ("simhash_dedup", dedup_documents), ("best_fit_packing", pack)]

#: SQL cannot express language identification, SimHash or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored as Parquet in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
