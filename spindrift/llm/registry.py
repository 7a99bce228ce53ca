"""The registered queries of this subpackage and the SQL that they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import op_decontamination, op_language_id, op_license_scan, op_media_columns, op_near_duplicates, op_packing, op_packing_examples, op_quality, op_token_counts, op_toxicity, op_url_filter
from spindrift.shipping import ship

_PARTS = (op_url_filter, op_token_counts, op_packing, op_decontamination, op_quality, op_language_id, op_toxicity, op_near_duplicates, op_license_scan, op_media_columns, op_packing_examples)



def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {part.NAME: _shipped(part.query) for part in _PARTS}
ORACLES: dict[str, str] = {part.NAME: part.ORACLE for part in _PARTS if part.ORACLE}
