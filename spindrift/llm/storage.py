"""The folder that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spindrift.sources.shared import shared_dir


def type_of(df: DataFrame, column: str) -> str:
    """A column's type as DDL."""
    return df.select(column).schema[0].dataType.simpleString()


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that ``df`` has already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spindrift-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lost executors cost no recomputation of what
    came before, and later plans start from these files. ``discard`` removes it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    mine = f"/spindrift-{spark.sparkContext.applicationId}/"
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles() if mine in f}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
