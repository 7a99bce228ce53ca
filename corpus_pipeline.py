"""A corpus pipeline: toxicity, quality, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next one's
docs. All but the last return the columns of ``documents``. The classifiers learn from the labels of all documents of
their stage's own input that carry one; their thresholds are those of the queries op6 and op3.

Defined cases, for every stage: a null text is an empty one to the classifiers, a class of its own to the near duplicates,
has no words to the decontamination and is packed as its end id; rows without id stay and are never joined away; of rows that
repeat id and text one is kept by the near duplicates; an empty table gives an empty one with the same columns; columns
beyond id and text pass through whatever their names.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import compression_quality, near_duplicates, op_packing, op_quality, op_toxicity, toxicity
from spindrift.llm.decontamination import remove_documents
from spindrift.llm.packing import pack_documents
from spindrift.llm.storage import fresh_path
from spindrift.shipping import ship


def _shipped(stage):
    """The stage, with this package sent to the executors before."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


@_shipped
def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that score at the threshold or above go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return docs.where(toxicity.toxicity_score(spark, model, F.col("text")) < op_toxicity.THRESHOLD)


@_shipped
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that score below the threshold go."""
    model = compression_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return docs.where(compression_quality.quality_score(spark, model, F.col("text")) >= op_quality.THRESHOLD)


@_shipped
def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: one document of each class of near duplicates stays, the one of least id."""
    return near_duplicates.keep_first(docs)


@_shipped
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that hold a window of a benchmark item go."""
    return remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_shipped
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the pieces of the kept documents and their places in sequences."""
    return pack_documents(docs, op_packing.VOCABULARY)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The stages learn, sign and tokenize, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied, in order, to the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = fresh_path(spark, name.replace(" ", "-"))
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
