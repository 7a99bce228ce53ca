"""Token counts of whole texts. Huge texts are encoded in overlapping chunks, resynchronised at stable boundaries.

Defined cases: a null or empty text has no tokens and no bytes; repeated rows are counted each; other columns pass
through; a column that already has a result's name is not replaced but an error, which ``prefix`` avoids; an empty table
gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.bpe import encoder


def count_tokens(df: DataFrame, vocabulary: str, *, text: str = "text", limit: int = 1024, prefix: str = "") -> DataFrame:
    """``df`` with n_bytes, n_tokens and over_limit (after ``prefix``). ``vocabulary`` is a path that each executor can open. Map-only."""
    names = [prefix + n for n in ("n_bytes", "n_tokens", "over_limit")]
    if taken := {*names} & {*df.columns}:
        raise ValueError(f"columns {sorted(taken)} exist already")

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        count = encoder(vocabulary).count
        return pd.Series([count(t) for t in texts], dtype="int64")

    counted = df.withColumn(names[0], F.coalesce(F.octet_length(text), F.lit(0)).cast("long")).withColumn(names[1], tokens(F.col(text)))
    return counted.withColumn(names[2], F.col(names[1]) > limit)
