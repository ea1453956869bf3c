"""Corpus pipeline: quality rules, line dedup, near dedup, decontamination, encoding.

Each stage takes what the one before kept, written as Parquet and read again; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lupa.llm import leaks, lines, long_bpe, near_dups, quality
from lupa.llm.queries import BYTES
from lupa.session import stage


def _bounded(spark: SparkSession) -> None:
    """Fewer texts in the batches that tasks and their workers hold at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    _bounded(spark)
    return quality.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without boilerplate lines of their source; ``n_chars`` follows the text.

    Equal texts count as one page: near dedup leaves one copy of a group, which must still have its lines.
    """
    left = lines.without_boilerplate(docs, "source", "text", distinct=True)
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the lowest id."""
    _bounded(spark)
    return near_dups.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    _bounded(spark)
    return leaks.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of each document, and digest of the text decoded from them."""
    _bounded(spark)
    found = long_bpe.encode_decode(docs, BYTES)
    return found.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: The cascade, the samples and the vocabulary can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
