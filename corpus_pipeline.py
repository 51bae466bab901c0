"""Corpus pipeline: documents -> training mix, in stages that are written and reread.

``run(spark, sf_dir)`` applies ``STAGES`` to the documents table.  Each stage is
``(spark, docs, sf_dir) -> DataFrame`` and calls one operator of ``jobatlas.llm``:

1. language id: documents without a letter or with an ambiguous language go;
2. SimHash near-dedup: one document of each component stays, the one with the smallest id;
3. substring dedup: repeated 50-word windows are cut out of the later documents (their kept words
   are joined by one space; other documents stay as they are); documents left without a word go;
4. benchmark decontamination: documents that hold a benchmark item go;
5. mixing: documents are drawn so that token shares meet the target marginals; the result
   also has ``tokens``, ``topic``, ``probability``, ``weight`` (repeats) and ``gap`` (distance from the targets).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobatlas.llm import decontaminate, langid, mixing, simhash, substring
from jobatlas.session import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs.select(*COLUMNS))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs.select(*COLUMNS))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(docs.select(*COLUMNS)).where("n_removed = 0 OR n_removed < n_words")
    cut = F.col("n_removed") > 0
    return out.select("doc_id", F.when(cut, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source",
                      F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS, "tokens", "topic", "probability", "weight", "gap")


STAGES = [("language_id", language_stage), ("simhash_near_dedup", near_dedup_stage),
          ("substring_dedup", substring_stage), ("benchmark_decontamination", decontamination_stage),
          ("mixing", mixing_stage)]

#: Learned, hashed and iterated stages have no SQL: tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
