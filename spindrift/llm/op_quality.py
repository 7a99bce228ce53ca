"""Query op3: the quality of every document; ids whose crc32 leaves 0 modulo 5 are held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.compression_quality import quality_score, train
from spindrift.llm.training import remainder

NAME = "op3_quality_classifier"
ORACLE = None
THRESHOLD = 0.3


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder("doc_id", 5) != 0)
    scored = documents.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), quality_score(spark, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
