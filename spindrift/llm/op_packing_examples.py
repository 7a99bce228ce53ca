"""Query packing_examples: every conversation as an instruction example, packed whole under three limits that all bind."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spindrift.llm.packing import Limits, conversation_demands, pack_examples

NAME = "packing_examples"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIMITS = Limits(tokens=4096, segments=20, loss=3200)
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = conversation_demands(spark.read.parquet(f"{sf_dir}/conversations.parquet"), VOCABULARY)
    return pack_examples(examples, "conv_id", "tokens", "segments", "loss", LIMITS)
