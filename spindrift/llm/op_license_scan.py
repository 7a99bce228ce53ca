"""Query op8: licence phrases and templates in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm.license_scan import scan_licenses

NAME = "op8_license_scan"
ORACLE = None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
