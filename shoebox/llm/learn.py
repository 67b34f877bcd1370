"""What the two classifiers share: labelled samples and calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(column: str = "doc_id", folds: int = 5):
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def sample(labels: DataFrame, label: str, size: int, keep) -> DataFrame:
    """At most `size` labelled rows (doc_id, y) that `keep` admits, by a hash of the id; bounded, so it may be broadcast."""
    rows = labels.where(keep).where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna()
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(size)


def with_labels(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(text, y) of the documents of a sample."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(rows), "doc_id").select("text", "y")


def logistic(x: np.ndarray, y: np.ndarray, centre: np.ndarray, ridge: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Coefficients of a logistic regression that are drawn to `centre`, by Newton's method."""
    w = centre.astype(float).copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - y) + ridge * (w - centre)
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        size = np.abs(step).max()
        w -= step * min(1.0, 4.0 / max(size, 1e-12))
        if size < 1e-6:
            break
    return w
