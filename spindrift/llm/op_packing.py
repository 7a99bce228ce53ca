"""Query op10: all documents packed into sequences of at most 1024 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spindrift.llm.packing import pack_documents

NAME = "op10_packing"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), VOCABULARY)
