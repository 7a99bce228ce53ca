"""Query op2: tokens of every document."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spindrift.llm.token_counts import count_tokens

NAME = "op2_token_counts"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(documents, VOCABULARY).drop("text")
