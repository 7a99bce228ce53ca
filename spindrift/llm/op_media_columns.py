"""Query op5: every document stored as an image and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm.media_columns import media_columns

NAME = "op5_media_columns"
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
