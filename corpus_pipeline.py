"""Corpus cleaning in five stages, each on all that the one before kept; every stage is written as Parquet and read again.

Columns of `documents` are kept up to the last stage (n_chars follows the text); packing returns pieces.

Null doc_ids are kept as null and rows that share a doc_id are judged by their texts, as each operator states; a null text has no words and is rejected
by the first stage. Texts of any length pass whole. Ties go as the operators state, an empty table gives empty stages, and further columns may have
any name that does not begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homolark.llm.common import discard, scratch
from homolark.llm.decontamination import decontaminate
from homolark.llm.line_dedup import line_dedup
from homolark.llm.packing import pack
from homolark.llm.quality_rules import quality_filter
from homolark.llm.simhash_dedup import simhash_dedup


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; kept ones lose their lines above the limit."""
    return _counted(quality_filter(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that had lines and lost all its words goes with them."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = line_dedup(docs, *rest).where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    return _counted(out.select(*[own.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays."""
    return simhash_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their ids' checksum."""
    import public_tokenizers

    out = pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_dedup", near_duplicates), ("decontamination", benchmark), ("packing", packing)]

#: Fingerprints and tokens are beyond SQL; the tests hold run() against the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:  # what the next stage has written does not need it any more
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
