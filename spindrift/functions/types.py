"""Declared column types of a schema file and Spark's."""

from __future__ import annotations

from pyspark.sql import types as T

#: Names that a schema file may use.
NAMES: dict[str, T.DataType] = {
    "int": T.IntegerType(),
    "int32": T.IntegerType(),
    "long": T.LongType(),
    "int64": T.LongType(),
    "double": T.DoubleType(),
    "float64": T.DoubleType(),
    "string": T.StringType(),
    "utf8": T.StringType(),
    "boolean": T.BooleanType(),
    "bool": T.BooleanType(),
    "date": T.DateType(),
}


def spark_type(name: str) -> T.DataType:
    try:
        return NAMES[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown column type {name!r}; known are {sorted(NAMES)}") from None


def schema_of(fields: list[dict]) -> T.StructType:
    """Fields as {name, type}; names are lower-cased and every column may be null."""
    return T.StructType([T.StructField(f["name"].lower(), spark_type(f["type"]), True) for f in fields])
