"""Files of tables: layout, CSV and Parquet scans, conversion, and hash partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUFFIX = {"csv": "tbl", "parquet": "parquet"}


def partition_paths(folder: str, table: str, form: str, n: int) -> list[str]:
    """One file ``T.tbl`` / ``T.parquet``, or ``T_sharded/T.tbl.i`` for several partitions."""
    name = f"{table}.{SUFFIX[form]}"
    return [f"{folder}/{name}"] if n == 1 else [f"{folder}/{table}_sharded/{name}.{i}" for i in range(n)]


def read(spark: SparkSession, form: str, paths: Sequence[str], schema: T.StructType | None = None, delimiter: str = "|", base: str | None = None) -> DataFrame:
    """CSV files have a header row; compressed ones are recognised by their suffix. No paths give no rows. With ``base``, Parquet
    files are read by the schema given, Hive partition columns below that folder included."""
    if not paths:
        if schema is None:
            raise ValueError("without paths a schema is needed")
        return spark.createDataFrame([], schema)
    if form == "parquet":
        reader = spark.read.option("basePath", base).schema(schema) if base and schema is not None else spark.read
        return reader.parquet(*paths)
    if form != "csv":
        raise ValueError(f"unknown format {form!r}")
    reader = spark.read.options(header=True, sep=delimiter, mode="FAILFAST", enforceSchema=True)
    return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(list(paths))


def convert(spark: SparkSession, source: str, target: str, schema: T.StructType, *, delimiter: str = "|", codec: str = "snappy", row_group_bytes: int = 128 << 20) -> None:
    """A CSV table written as Parquet."""
    read(spark, "csv", [source], schema, delimiter).write.option("compression", codec).option("parquet.block.size", row_group_bytes).mode("overwrite").parquet(target)


def write_csv(df: DataFrame, target: str, delimiter: str = "|", codec: str = "none") -> None:
    df.write.options(header=True, compression=codec, sep=delimiter, timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS").mode("overwrite").csv(target)


def hash_partition(df: DataFrame, target: str, n: int, key: str | None = None) -> None:
    """A table rewritten in n partitions by a key's hash (without a key, evenly)."""
    (df.repartition(n, F.col(key)) if key else df.repartition(n)).write.mode("overwrite").parquet(target)


def bucket(df: DataFrame, table: str, n: int, key: str) -> DataFrame:
    """A managed table in n buckets of a key, sorted by it: joins of two such tables on the key need no exchange."""
    df.write.bucketBy(n, key).sortBy(key).mode("overwrite").format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)
