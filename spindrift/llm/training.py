"""Bounded training samples, folds and a small logistic calibrator for the corpus classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.storage import materialize

def remainder(key: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % mod


def labelled_rows(documents: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, *, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` labelled rows of each class 0 and 1, whole texts, chosen by the hash of the id among rows where
    ``learn`` holds: columns k, t, y, written to the shared folder (``discard`` removes it). And how many such labels there
    are. Only the number of rows is bounded; texts stay on the executors. Labels of other values or without id are left out;
    an id labelled both 0 and 1 counts as 1; of an id that repeats in documents the least text is taken, a null text as empty."""
    marked = labels.select(F.col(key).alias("k"), F.col(label).alias("y"), learn.alias("learn")).where("learn and y in (0, 1) and k is not null").groupBy("k").agg(F.max("y").cast("int").alias("y"))
    counts = {r[0]: r[1] for r in marked.groupBy("y").count().collect()}  # two rows
    chosen = labels.sparkSession.createDataFrame([], "k long, y int")
    for i, y in enumerate(sorted(counts)):
        part = marked.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(per_class)
        chosen = chosen.unionByName(part) if i else part
    texts = documents.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.min("t").alias("t"))
    return materialize(texts.select("k", "t", "y"), "labelled"), counts


def rows_of(rows: DataFrame, columns: str) -> list:
    """A bounded table's columns in the order of its keys ``k``."""
    return sorted(rows.select("k", *columns.split()).collect(), key=lambda r: r.k)


class Logistic:
    """Ridge logistic regression by Newton steps on standardised features and their products."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, *, ridge: float = 1e-2, products: bool = True) -> None:
        self.products = products
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        a = self._expand(x)
        self.w = np.zeros(a.shape[1])

        def loss(w: np.ndarray) -> float:
            z = a @ w
            return float((weight * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * (w @ w))

        now = loss(self.w)
        for _ in range(100):
            p = self._squash(a @ self.w)
            gradient = a.T @ (weight * (p - y)) + ridge * self.w
            h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(self.w))
            step = np.linalg.solve(h, gradient)
            # the loss is convex: a full step may overshoot, a short enough one never does
            size, slope = 1.0, float(gradient @ step)
            while (after := loss(self.w - size * step)) > now - 1e-4 * size * slope and size > 1e-10:
                size /= 2
            if after >= now:
                break
            self.w -= size * step
            done, now = now - after < 1e-10 * (1 + now), after
            if done:
                break

    @staticmethod
    def _squash(v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(v, -30, 30)))

    def _expand(self, x: np.ndarray) -> np.ndarray:
        b = np.clip((x - self.mean) / self.scale, -8, 8)
        k = b.shape[1]
        more = [b[:, [i]] * b[:, [j]] for i in range(k) for j in range(i, k)] if self.products else []
        return np.concatenate([b, *more, np.ones((len(b), 1))], axis=1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._squash(self._expand(x) @ self.w)


def class_weights(y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Weights that give a sample with equal classes the shares that the labels have."""
    total, n = sum(counts.values()), len(y)
    return np.array([counts[int(v)] / total / ((y == v).sum() / n) for v in y])
