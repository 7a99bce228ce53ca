"""Language identification in two steps: the language family, then one-versus-one linear support vector machines in it.

Families are learned too: languages whose mean profiles of character n-grams are closer than the average pair are
joined. Features are hashed byte n-grams of 1 to 3 letters, lower-cased, with word edges, as logarithms of counts of
length 1. Whole texts are read, in blocks.

Training uses at most ``PER_LANGUAGE`` texts of each language, and fewer of each where there are so many languages that the
sample would exceed ``SAMPLE_TEXTS`` (see ``language_sample``); no language is left out and no text is cut. Texts become
vectors on the executors; only these are collected. The model is one vector of ``DIMENSIONS`` for each family and for each
pair in a family. Defined cases: null texts and texts without a letter (Unicode category L) are ``und`` with score 0; with
one language learned it is always predicted; with none, ``und``; repeated rows are judged each; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm.storage import discard, materialize

#: Texts of a language, and of all languages together unless there are more languages than that.
PER_LANGUAGE, SAMPLE_TEXTS = 600, 6000
DIMENSIONS = 1 << 12
BLOCK_BYTES = 1 << 18
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_NOT_LETTERS = regex.compile(r"\P{L}+")


def counts(text: str) -> np.ndarray:
    """Hashed byte n-grams (1 to 3) of the letters, each run of anything else being one space."""
    raw = np.frombuffer(f" {_NOT_LETTERS.sub(' ', text.lower())} ".encode("utf-8", "surrogatepass"), dtype=np.uint8)
    total = np.zeros(DIMENSIONS)
    for at in range(0, max(len(raw) - 2, 1), BLOCK_BYTES):
        b = raw[at : at + BLOCK_BYTES + 2].astype(np.uint32)
        one, two = b[: len(b) - 2], b[: len(b) - 2] * 257 + b[1 : len(b) - 1]
        for h in (one * 31, two + 7919, two * 65537 + b[2:] * 40503):
            total += np.bincount(((h * np.uint32(2654435761)) >> np.uint32(20)) & (DIMENSIONS - 1), minlength=DIMENSIONS)
    return total


def vector(text: str) -> np.ndarray:
    v = np.log1p(counts(text))
    return v / (np.sqrt(v @ v) or 1.0)


def linear_svm(x: np.ndarray, y: np.ndarray, *, c: float = 4.0, rounds: int = 12) -> np.ndarray:
    """Weights of a linear SVM (hinge loss) by dual coordinate descent; y is -1 or 1; the last weight is the bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    share = {s: len(y) / (2 * max((y == s).sum(), 1)) for s in (-1, 1)}
    top = np.array([c * share[s] for s in y])
    w, a, norm = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(axis=1)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1
            new = min(max(a[i] - g / norm[i], 0.0), top[i])
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w.astype(np.float32)


def group_families(profiles: np.ndarray) -> list[int]:
    """Single-link groups of languages whose profiles are more alike than the average pair is."""
    n = len(profiles)
    unit = profiles / np.linalg.norm(profiles, axis=1, keepdims=True)
    alike = unit @ unit.T
    if n < 3:
        return list(range(n))
    mean = alike[np.triu_indices(n, 1)].mean()
    family = list(range(n))
    for i, j in combinations(range(n), 2):
        if alike[i, j] > mean:
            old, new = family[j], family[i]
            family = [new if f == old else f for f in family]
    return family


@dataclass
class LanguageModel:
    languages: list[str]
    families: list[list[int]] = field(default_factory=list)
    family_weights: np.ndarray | None = None
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0
        v = np.append(vector(text), 1.0).astype(np.float32)
        inside, sure = self.families[0], 1.0
        if len(self.families) > 1:
            margins = self.family_weights @ v
            best = int(margins.argmax())
            inside, sure = self.families[best], 1 / (1 + np.exp(-3 * float(margins[best])))
        votes = {i: [0, 0.0] for i in inside}
        for i, j in combinations(inside, 2):
            m = float(self.pairs[i, j] @ v)
            votes[i if m > 0 else j][0] += 1
            votes[i][1] += m
            votes[j][1] -= m
        winner = max(inside, key=lambda i: (votes[i][0], votes[i][1], -i))
        if len(inside) > 1:
            sure *= 1 / (1 + np.exp(-3 * votes[winner][1] / (len(inside) - 1)))
        return self.languages[winner], float(sure)


def fit(sample: list[tuple[np.ndarray, str]]) -> LanguageModel:
    """``sample``: vectors of texts with their languages."""
    languages = sorted({lang for _, lang in sample})
    if len(languages) < 2:
        return LanguageModel(languages, [[0]] if languages else [])
    x = np.array([v for v, _ in sample], dtype=np.float32)
    of = np.array([languages.index(lang) for _, lang in sample])
    family = group_families(np.array([x[of == i].mean(axis=0) for i in range(len(languages))]))
    model = LanguageModel(languages, [[i for i, f in enumerate(family) if f == g] for g in sorted(set(family))])
    if len(model.families) > 1:
        model.family_weights = np.array([linear_svm(x, np.where(np.isin(of, inside), 1, -1)) for inside in model.families])
    for inside in model.families:
        for i, j in combinations(inside, 2):
            both = (of == i) | (of == j)
            model.pairs[i, j] = linear_svm(x[both], np.where(of[both] == i, 1, -1))
    return model


def language_sample(documents: DataFrame, learn: Column, *, per_language: int = PER_LANGUAGE, total: int = SAMPLE_TEXTS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[np.ndarray, str]]:
    """Vectors and languages of at most ``per_language`` texts of each language among rows where ``learn`` holds: those of
    smallest hash of the id. With more than ``total / per_language`` languages each gets its share of ``total``, one text at
    least. A first pass counts the languages, so that the second keeps little more than the sample before it is ranked."""
    rows = documents.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & learn).select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).cast("string").alias("t"))
    sizes = materialize(rows.groupBy("l").agg(F.count("*").alias("n")), "languages")
    each = max(1, min(per_language, total // max(sizes.count(), 1)))
    place = F.pmod(F.xxhash64("k"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    few = rows.withColumn("p", place).join(F.broadcast(sizes), "l").where(F.col("p") < 4.0 * each / F.col("n") + 1e-9)
    few = few.groupBy("l", "k", "p").agg(F.min("t").alias("t"))
    ranked = materialize(few.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("p", "k"))).where(F.col("r") <= each).select("l", "k", "t"), "sample")

    @F.pandas_udf("binary")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series([vector(t).astype(np.float16).tobytes() for t in texts])

    found = ranked.select("l", "k", vectors("t").alias("v")).collect()  # ``total`` rows of 2 * DIMENSIONS bytes
    discard(sizes)
    discard(ranked)
    return [(np.frombuffer(v, np.float16).astype(np.float32), lang) for lang, _, v in sorted((r.l, repr(r.k), bytes(r.v)) for r in found)]


def predict_language(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sent.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predicted(text)
