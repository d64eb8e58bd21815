"""Corpus pipeline: quality rules, quality classifier, near-duplicates, personal data, packing.

Each stage works on all that the one before it kept; what it returns is written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weftscan.llm import minhash, packing, pii, quality_classifier, quality_rules
from weftscan.llm.store import shared_dir

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("quality_classifier", quality_classifier.stage),
    ("minhash", minhash.stage),
    ("pii", pii.stage),
    ("packing", packing.stage),
]

#: The fitted stages have no SQL form; tests hold run() against brute force on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
