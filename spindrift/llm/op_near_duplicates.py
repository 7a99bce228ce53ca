"""Query op4: the class of near duplicates of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm.near_duplicates import near_duplicate_classes

NAME = "op4_near_duplicates"
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("id", "class_id", "class_rows").withColumnRenamed("id", "doc_id")
