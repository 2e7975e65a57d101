"""The corpus pipeline: quality, line dedup, near duplicates, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again before the next stage.  All stages but the last return the columns
of `documents`.  Null texts count as empty, except in line dedup, which passes them
through.  Copies and leaks are judged by id and text: rows without an id take part,
another text under the same id is judged for itself, and of repeated rows one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.llm import bpe, decontaminate, line_dedup, quality, simhash
from chronopanel.llm.queries import quality_model
from chronopanel.llm.shared import stored


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go, their earliest copy stays; n_chars follows the text."""
    out = line_dedup.dedup(docs).select(docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by fingerprints within 2 bits, of three-word shingles, one document stays: the smallest id."""
    return simhash.one_of_each(docs, shingle=3, radius=2).select(docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and a digest of the text that they decode to."""
    coded = bpe.encode(docs, with_text=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("bpe", encode_bpe),
]

#: XXH64 and the trained quality classifier have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
