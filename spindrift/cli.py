"""A prompt: ``sql <text>;``, ``file <path>;`` or ``quit``, over the Parquet tables of a folder.

python -m spindrift.cli FOLDER [--mode hybrid] [--prefilter semi] [--transfer-order breadth_first] [--cache-policy lru]
[--cache-bytes N] [--no-zone-maps]. The cache lasts from query to query.
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Iterator
from pathlib import Path
from typing import TextIO

from pyspark.sql import SparkSession

from spindrift.config import EngineConfig, Mode, Prefilter, TransferOrder
from spindrift.plans.engine import Engine
from spindrift.plans.sql import run_sql
from spindrift.sources.policies import POLICIES


def commands(lines: Iterator[str]) -> Iterator[tuple[str, str]]:
    """Commands that end with a semicolon (``quit`` needs none), over as many lines as they take."""
    held = ""
    for line in lines:
        held += line
        if held.strip().lower() in ("quit", "quit;", "exit", "exit;"):
            yield "quit", ""
            return
        if held.rstrip().endswith(";"):
            word, _, rest = held.strip().rstrip(";").partition(" ")
            yield word.lower(), rest.strip()
            held = ""


def serve(spark: SparkSession, folder: str, lines: Iterator[str], out: TextIO, config: EngineConfig | None = None) -> None:
    engine = Engine(spark, folder, config) if config is not None else None
    for word, rest in commands(lines):
        if word == "quit":
            return
        if word not in ("sql", "file"):
            print(f"unknown command {word!r}; known are sql, file and quit", file=out)
            continue
        begun = time.time()
        try:
            text = rest if word == "sql" else Path(rest).read_text(encoding="utf-8")
            print((engine.sql(text) if engine else run_sql(spark, folder, text))._show_string(1000, False, False), file=out)
            print(f"{time.time() - begun:.2f} s", file=out)
        except Exception as e:  # the prompt goes on after a failed query
            print(f"error: {str(e).splitlines()[0]}", file=out)


def options(arguments: list[str]) -> tuple[str, EngineConfig | None]:
    """The folder, and the options if any is given."""
    parser = argparse.ArgumentParser(prog="spindrift.cli")
    parser.add_argument("folder")
    for name, kind in (("mode", Mode), ("prefilter", Prefilter), ("transfer-order", TransferOrder)):
        parser.add_argument(f"--{name}", type=kind, choices=[*kind], metavar="|".join(x.value for x in kind))
    parser.add_argument("--cache-policy", choices=[*POLICIES])
    parser.add_argument("--cache-bytes", type=int)
    parser.add_argument("--no-zone-maps", dest="zone_maps", action="store_const", const=False)
    found = vars(parser.parse_args(arguments))
    folder, given = found.pop("folder"), {k: v for k, v in found.items() if v is not None}
    return folder, EngineConfig(**given) if given else None


def main() -> None:
    folder, config = options(sys.argv[1:])
    spark = SparkSession.builder.appName("spindrift").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    serve(spark, folder, iter(sys.stdin.readline, ""), sys.stdout, config)


if __name__ == "__main__":
    main()
