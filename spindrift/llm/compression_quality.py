"""Quality by compression: zstandard dictionaries made from good and from bad labelled text.

A text that compresses better with the good dictionary than with the bad one resembles good text. The difference of the
two sizes, normalised by their sum, and the sizes by the text's own, are calibrated to a probability on labelled texts that
made neither dictionary. Texts are compressed whole, in blocks, so that a long one can't outgrow the dictionaries.

Training uses at most ``PER_CLASS`` labelled texts of each class (see ``labelled_rows``): half of them give ``PARTS`` parts
each to the dictionaries, the others are compressed whole, on the executors, to calibrate. The model is two dictionaries of
``DICTIONARY_BYTES`` and a few weights, so its broadcast is bounded. Defined cases: null and empty texts score like
an empty text; equal texts score equally; with no label of one class the score is the share of the other everywhere
(0.5 with no labels); empty tables give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.storage import discard
from spindrift.llm.training import Logistic, class_weights, labelled_rows, rows_of
from spindrift.llm.worker import turn

PER_CLASS = 3000
DICTIONARY_BYTES = 64 << 10
BLOCK_BYTES, LEVEL = 4096, 3
#: Training samples for a dictionary: this many parts of each text, of as many bytes.
PARTS, PART_BYTES = 4, 2048


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    calibrate: Logistic | None
    constant: float = 0.5

    def __post_init__(self) -> None:
        self._ready: list | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None}

    def _compressors(self) -> list:
        if self._ready is None:
            self._ready = []
            for raw in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=LEVEL)
                self._ready.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))
            self._ready.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False))
        return self._ready

    def features(self, text: str | None) -> list[float]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        sizes = [0, 0, 0]
        for at in range(0, max(len(raw), 1), BLOCK_BYTES):
            block = raw[at : at + BLOCK_BYTES]
            for i, c in enumerate(self._compressors()):
                sizes[i] += len(c.compress(block))
        good, bad, plain = sizes
        n = len(raw) + 1
        return [(good - bad) / (good + bad + 8), good / n, plain / n, math.log(n)]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.calibrate is None or not texts:
            return np.full(len(texts), self.constant)
        return self.calibrate(np.array([self.features(t) for t in texts]))


def spaced(raw: bytes, most: int) -> list[bytes]:
    """At most ``most`` parts of ``PART_BYTES``, evenly spaced."""
    n = -(-len(raw) // PART_BYTES)
    return [raw[i * PART_BYTES : (i + 1) * PART_BYTES] for i in (range(n) if n <= most else np.linspace(0, n - 1, most).astype(int).tolist())]


def _dictionary(parts: list[bytes]) -> bytes:
    """A dictionary of the parts of texts: of each text some, so that all of them teach."""
    parts = [p for p in parts if len(p) > 8]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(parts)[-DICTIONARY_BYTES:] or b"\n" * 8


def train(documents: DataFrame, labels: DataFrame, learn: Column, *, label: str = "quality", per_class: int = PER_CLASS, **names) -> QualityModel:
    rows, counts = labelled_rows(documents, labels, label, learn, per_class, **names)
    spark = documents.sparkSession

    @F.pandas_udf("array<binary>")
    def parts(texts: pd.Series) -> pd.Series:
        return pd.Series([spaced(t.encode("utf-8", "surrogatepass"), PARTS) for t in texts])

    # every second text of a class goes to its dictionary, the rest calibrates; the order is by id
    keys = {y: [r.k for r in rows_of(rows.where(F.col("y") == y), "y")] for y in (0, 1)}
    if not (keys[0] and keys[1]):
        discard(rows)
        return QualityModel(b"", b"", None, counts.get(1, 0) / sum(counts.values()) if counts else 0.5)
    teaches = spark.createDataFrame([(k,) for y in (0, 1) for k in keys[y][::2]], rows.select("k").schema)
    # at most per_class texts of PARTS parts each
    found = rows_of(rows.join(F.broadcast(teaches), "k", "left_semi").select("k", "y", parts("t").alias("parts")), "y parts")
    model = QualityModel(*(_dictionary([bytes(p) for r in found if r.y == y for p in r.parts]) for y in (1, 0)), None)
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([sent.value.features(t) for t in texts])

    lone = [keys[y][0] for y in (0, 1) if len(keys[y]) == 1]  # a class of one text has it for both
    rest = rows.join(F.broadcast(teaches.where(~F.col("k").isin(lone))), "k", "left_anti")
    found = rows_of(rest.select("k", "y", features("t").alias("x")), "y x")
    discard(rows)
    y = np.array([r.y for r in found])
    model.calibrate = Logistic(np.array([r.x for r in found]), y, class_weights(y, counts))
    return model


def quality_score(spark: SparkSession, model: QualityModel, text: Column) -> Column:
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        turn("quality")
        return pd.Series(sent.value.scores(texts.tolist()))

    return score(text)
