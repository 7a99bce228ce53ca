"""Query op7: words of documents inside windows of benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm.decontamination import leak_report

NAME = "op7_decontamination"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), starts AS (
  SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0
), grams AS (
  SELECT DISTINCT item, array_to_string(w[i:i + 9], ' ') AS gram, least(len(w), 10) AS n FROM starts
), lengths AS (
  SELECT DISTINCT n FROM grams
), places AS (
  SELECT r, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, lengths
), hits AS (
  SELECT r, i, g.n, item FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM places) p JOIN grams g ON p.gram = g.gram AND p.n = g.n
), inside AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN inside USING (r) LEFT JOIN items USING (r)
"""
