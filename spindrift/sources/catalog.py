"""The metadata catalogue: declared schemas, statistics, zone maps and partitioning keys.

A schema folder holds ``schema.json``, ``stats.json``, ``zoneMap.json`` and, where tables are hash-partitioned, a file of
hash keys; all but the first may be missing. Statistics and zone maps can also be collected from the data.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.functions.types import schema_of
from spindrift.operators.pruning import value_order
from spindrift.sources import files


@dataclass
class Table:
    name: str
    form: str
    paths: list[str]
    schema: T.StructType | None = None
    delimiter: str = "|"
    rows: int | None = None
    column_bytes: dict[str, float] = field(default_factory=dict)
    zones: dict[str, dict[str, tuple[Any, Any]]] = field(default_factory=dict)
    hash_key: str | None = None
    #: The folder that Hive partition columns (``column=value`` folders) are read from, if the table has such.
    base: str | None = None

    def read(self, spark: SparkSession, paths: Sequence[str] | None = None) -> DataFrame:
        return files.read(spark, self.form, self.paths if paths is None else paths, self.schema, self.delimiter, self.base)


@dataclass
class Catalog:
    tables: dict[str, Table]

    @classmethod
    def from_metadata(cls, read_text, data_folder: str) -> Catalog:
        """``read_text(name)`` gives a metadata file's text, or None where there is none."""

        def load(name: str) -> dict:
            text = read_text(name)
            return json.loads(text) if text else {}

        tables = {}
        for t in load("schema.json")["tables"]:
            name, form = t["name"].lower(), t["format"]["name"].lower()
            tables[name] = Table(name, form, files.partition_paths(data_folder, name, form, t["numPartitions"]), schema_of(t["fields"]), t["format"].get("fieldDelimiter", "|"))
        for t in load("stats.json").get("tables", []):
            table = tables[t["name"].lower()]
            table.rows = t["stats"]["rowCount"]
            table.column_bytes = {c.lower(): v for c, v in t["stats"].get("apxColumnLength", {}).items()}
        for t in load("zoneMap.json").get("tables", []):
            table = tables[t["name"].lower()]
            for zone in t["zoneMap"]:
                for path, pair in zip(table.paths, zone["valuePairs"], strict=True):
                    table.zones.setdefault(path, {})[zone["field"].lower()] = (pair["min"], pair["max"])
        for t in load("hash_keys.json").get("hashKeys", []):
            tables[t["table"].lower()].hash_key = t["key"].lower()
        return cls(tables)

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, names: Sequence[str]) -> Catalog:
        """Parquet tables ``folder/name.parquet``; one partition for each data file."""
        tables = {}
        for n in names:
            df = spark.read.parquet(f"{folder}/{n}.parquet")
            root, paths = f"{folder}/{n}.parquet", sorted(df.inputFiles())
            nested = any("=" in p[len(root) :] and "/" in p[len(root) :].strip("/") for p in map(plain_path, paths))
            tables[n] = Table(n, "parquet", paths, df.schema, base=root if nested else None)
        return cls(tables)

    def __getitem__(self, name: str) -> Table:
        try:
            return self.tables[name.lower()]
        except KeyError:
            raise ValueError(f"no table {name!r}; known are {sorted(self.tables)}") from None

    def register(self, spark: SparkSession) -> None:
        """Every table as a view."""
        for t in self.tables.values():
            t.read(spark).createOrReplaceTempView(t.name)


def collect_rows(spark: SparkSession, table: Table) -> int:
    """Rows, from the file footers where the format has them."""
    table.rows = table.read(spark).count()
    return table.rows


def collect_zones(spark: SparkSession, table: Table, columns: Sequence[str]) -> dict[str, dict[str, tuple[Any, Any]]]:
    """Least and greatest value of each column in each partition, in one distributed pass. Only a row per partition comes to
    the driver. A column of nulls has no zone. Zeros lose their sign."""
    zeros = {f.name for f in table.read(spark).schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    value = {c: F.col(c) + F.lit(0.0) if c in zeros else F.col(c) for c in columns}
    table.zones = {}
    found = table.read(spark).groupBy(F.input_file_name().alias("_path")).agg(*(f(value[c]).alias(f"{k}_{c}") for c in columns for k, f in (("min", F.min), ("max", F.max))))
    find = partition_of(table.paths)
    for r in found.collect():
        zone = table.zones.setdefault(find(r._path), {})
        for c in columns:
            if r[f"min_{c}"] is not None:
                pair = (r[f"min_{c}"], r[f"max_{c}"])
                held = (*zone[c], *pair) if c in zone else pair
                zone[c] = (min(held, key=value_order), max(held, key=value_order))
    return table.zones


def partition_of(paths: Sequence[str]) -> Callable[[str], str]:
    """Which of the partitions a file belongs to."""
    partition = {plain_path(p): p for p in paths}

    def find(uri: str) -> str:
        file = plain_path(uri)
        while file and file not in partition:  # a partition may be a folder of files
            file = file.rpartition("/")[0]
        return partition[file]

    return find


def plain_path(uri: str) -> str:
    """A path without scheme, host of local files, escapes and trailing slashes."""
    return unquote(re.sub(r"^file:/+", "/", uri)).rstrip("/")
