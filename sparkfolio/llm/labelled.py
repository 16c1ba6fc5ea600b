"""What the two classifiers share: bounded samples of labelled rows, and calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import sample_by_hash


def crc_bucket(id_col: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def sample_ids(labels: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """At most per_class ids of each label 0 and 1, by a hash of the id, as (_id, _label, _n); and the number of labelled rows.

    The ids are at most 2 * per_class rows, so they may be broadcast.
    """
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).filter("_label IN (0, 1) AND _id IS NOT NULL")
    counts = {r[0]: r[1] for r in rows.groupBy("_label").count().collect()}
    unique: dict = {}
    placed = {0: 0, 1: 0}
    for key, label in sample_by_hash(rows, "_label", "_id", per_class):
        if key not in unique:
            placed[label] += 1
            unique[key] = (key, label, placed[label])
    return labels.sparkSession.createDataFrame(list(unique.values()), f"_id {rows.schema['_id'].dataType.simpleString()}, _label int, _n int"), counts


def labelled_texts(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _text, _label, _n) of the documents in ids."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    return rows.join(F.broadcast(ids), "_id")


class Logistic:
    """Logistic regression by Newton's method with a small ridge; the calibration of raw scores into probabilities."""

    def __init__(self, features: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1e-2):
        n, k = features.shape
        self.mean = features.mean(0) if n else np.zeros(k)
        self.scale = np.maximum(features.std(0), 1e-9) if n else np.ones(k)
        self.coef = np.zeros(k + 1)
        if not n or labels.min() == labels.max():
            return
        x = self._design(features)
        w = weights / weights.mean()
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ self.coef, -30, 30)))
            grad = x.T @ (w * (p - labels)) + ridge * self.coef
            hess = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(k + 1)
            step = np.linalg.solve(hess, grad)
            self.coef -= step
            if np.abs(step).max() < 1e-8:
                break

    def _design(self, features: np.ndarray) -> np.ndarray:
        z = np.clip((features - self.mean) / self.scale, -8, 8)
        return np.hstack([z, np.ones((len(z), 1))])

    def predict(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(features) @ self.coef, -30, 30)))
