"""Query op9: the language of every document; ids whose crc32 leaves 2 modulo 4 are held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.language_id import fit, language_sample, predict_language
from spindrift.llm.training import remainder

NAME = "op9_language_id"
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(language_sample(documents, remainder("doc_id", 4) != 2))
    found = documents.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), predict_language(spark, model, F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")
