"""The corpus pipeline: quality rules, near duplicates, secrets, mixing, packing.

Every stage takes the documents that its predecessor kept and returns documents;
the last returns the packed pieces. ``run`` writes each stage's documents as
Parquet to the shared folder and reads them again for the next.
"""

from __future__ import annotations

import tempfile
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leafpress.llm import jaccard, mixing, packing, quality, secrets


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the classifier."""
    return quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=True)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.distinct(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", keep_quality),
    ("near_duplicates", keep_distinct),
    ("secret_scan", mask_secrets),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: The classifier, the token vocabulary and the packing have no SQL form.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by the file system that Spark reads it with."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. A stage's documents are deleted
    when the next stage's are written; only those that the result is read from stay."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="pipeline-")
    folder, last = f"{shared}/pipeline-{uuid.uuid4().hex}", None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            _remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
