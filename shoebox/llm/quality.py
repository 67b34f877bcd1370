"""Document quality by regularised quadratic discriminant analysis.

Each class has a mean and a covariance of transformed document statistics; covariances
are shrunk towards the pooled one and a diagonal, factored once, and kept as Cholesky
factors.  The score is the difference of the classes' log-densities, which follow from
Mahalanobis lengths by triangular solves, calibrated to a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import learn
from .spark_tools import saved, ship

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
SHRINK, RIDGE = 0.1, 1e-2
THRESHOLD = 0.3
N_FEATURES = 17


def _by_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.zeros(flags.size + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return (sums[off[1:]] - sums[off[:-1]]).astype(float)


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(h.size, bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(doc[new], minlength=n).astype(float)


def statistics(column: pa.Array) -> np.ndarray:
    """Transformed statistics of each text; all of them finite, for empty texts too."""
    buf, off = K.texts_of(column)
    n = off.size - 1
    size = np.diff(off).astype(float)
    low = K.lower_table()[buf]
    s, e, doc = K.runs(K.word_table()[buf], off)
    words = np.bincount(doc, minlength=n).astype(float)
    h = K.Hashes(low).of(s, e)
    length = (e - s).astype(float)
    per_word = np.maximum(words, 1)

    def share(*codes: int) -> np.ndarray:
        t = np.zeros(256, bool)
        t[list(codes)] = True
        return _by_doc(t[buf], off) / np.maximum(size, 1)

    upper, letters = share(*range(65, 91)), share(*range(65, 91), *range(97, 123), *range(128, 256))
    symbols, pipes, shouts, ends = share(*b"#*$%&<>@^~="), share(124), share(33), share(*b".?")
    digits, commas, foreign = share(*range(48, 58)), share(*b",;:"), share(*range(128, 256))
    distinct = _distinct(h, doc, n)
    same = np.zeros(h.size, bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    again = np.bincount(doc[same], minlength=n) / per_word
    grams, gram_doc = K.shingles(h, doc, n, 3)
    windows = np.maximum(np.bincount(gram_doc, minlength=n), 1)
    repeated = 1 - _distinct(grams, gram_doc, n) / windows
    ls, le, ldoc = K.runs(buf != 10, off)
    lines = np.maximum(np.bincount(ldoc, minlength=n), 1)
    dup_lines = 1 - _distinct(K.Hashes(buf).of(ls, le), ldoc, n) / lines
    mean = np.bincount(doc, length, n) / per_word
    spread = np.sqrt(np.maximum(np.bincount(doc, length**2, n) / per_word - mean**2, 0))
    rare = lambda x: np.log(x + 2e-3)
    out = np.stack(
        [np.log1p(words), np.log1p(mean), np.log1p(spread), rare(upper / np.maximum(letters, 1e-9) * (letters > 0)), rare(symbols), rare(pipes), rare(shouts), rare(ends), rare(digits), rare(commas), rare(foreign), np.log(distinct + 1) - 0.8 * np.log(words + 1), rare(again), rare(repeated), rare(dup_lines), np.log1p(words / lines), rare(1 - letters)],
        axis=1,
    )
    return np.nan_to_num(out)


def forward(lower: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of lower @ u = b, row by row: the factor is a triangle."""
    u = np.empty_like(b)
    for k in range(len(lower)):
        u[k] = (b[k] - lower[k, :k] @ u[:k]) / lower[k, k]
    return u


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    #: By class: mean, Cholesky factor of the covariance, log-determinant; None if a class has no rows.
    classes: list[tuple[np.ndarray, np.ndarray, float]] | None
    prior: float
    slope: float = 1.0
    shift: float = 0.0

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        if self.classes is None:
            return np.zeros(len(x))
        z = (x - self.centre) / self.scale
        dens = []
        for mean, factor, log_det in self.classes:
            dens.append(-0.5 * ((forward(factor, (z - mean).T) ** 2).sum(axis=0) + log_det))
        return dens[1] - dens[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), self.prior)
        t = self.slope * squash(self.log_odds(x)) + self.shift
        return 1 / (1 + np.exp(-np.clip(t, -700, 700)))


def squash(z: np.ndarray) -> np.ndarray:
    """Keeps the order of log-density differences, but not their size in the tails."""
    return np.arcsinh(z / 4) * 4


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in K.slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array(list(statistics(x.column("text"))), pa.list_(pa.float64())), x.column("y")], ["x", "y"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By class: the number of rows, their sum and the sum of their outer products, in one list."""
    sums = np.zeros((2, 1 + N_FEATURES + N_FEATURES**2))
    for x in batches:
        f, y = x.column("x").flatten().to_numpy().reshape(-1, N_FEATURES), x.column("y").to_numpy()
        for k in (0, 1):
            own = f[y == k]
            sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).reshape(-1)])
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(sums))], ["y", "sums"])


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, folds: int = 5, held_out: int = 0) -> Model:
    """A model of labels.quality from at most `size` labelled rows outside of the held-out fold.

    Repeated and contradictory rows of `labels` each count.
    """
    ship(docs.sparkSession)
    picked = learn.with_labels(docs, learn.sample(labels, "quality", size, learn.fold(folds=folds) != held_out))
    # one scan of the documents: the statistics of the sample are kept
    rows = saved(picked.mapInArrow(_featured, "x array<double>, y int"), "sample")
    n, one, two = np.zeros(2), np.zeros((2, N_FEATURES)), np.zeros((2, N_FEATURES, N_FEATURES))
    # sums by class and place, so the driver gets as many numbers as a class has, whatever the number of tasks
    sums = rows.mapInArrow(_moments, "y int, sums array<double>").select("y", F.posexplode("sums").alias("at", "v")).groupBy("y", "at").agg(F.sum("v").alias("v"))
    for r in sums.groupBy("y").agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("s")).select("y", F.expr("transform(s, x -> x.v)").alias("v")).collect():
        v = np.array(r["v"])
        n[r["y"]], one[r["y"]], two[r["y"]] = v[0], v[1 : 1 + N_FEATURES], v[1 + N_FEATURES :].reshape(N_FEATURES, N_FEATURES)
    total = n.sum()
    prior = float((n[1] + 1) / (total + 2))
    if n.min() < 2:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), None, prior)
    centre = one.sum(axis=0) / total
    scale = np.sqrt(np.maximum(np.diagonal(two.sum(axis=0)) / total - centre**2, 1e-6))
    means = (one / n[:, None] - centre) / scale
    covs = []
    for k in (0, 1):
        mean = one[k] / n[k]
        covs.append((two[k] / n[k] - np.outer(mean, mean)) / np.outer(scale, scale))
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / total
    classes = []
    for k in (0, 1):
        weight = SHRINK + (1 - SHRINK) * N_FEATURES / (n[k] + N_FEATURES)  # small classes lean on the pooled covariance
        cov = (1 - weight) * covs[k] + weight * pooled
        factor = np.linalg.cholesky(cov + RIDGE * np.eye(N_FEATURES))
        classes.append((means[k], factor, float(2 * np.log(np.diagonal(factor)).sum())))
    model = Model(centre, scale, classes, prior)

    def odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.log_odds(x.column("x").flatten().to_numpy().reshape(-1, N_FEATURES))), x.column("y")], ["z", "y"])

    seen = rows.mapInArrow(odds, "z double, y int").toPandas()  # as many rows as the sample
    z, y = squash(seen["z"].to_numpy()), seen["y"].to_numpy()
    w = learn.logistic(np.stack([z, np.ones(z.size)], axis=1), y, np.array([0.2, 0.0]), np.array([1e-2, 1e-2]))
    model.slope, model.shift = max(float(w[0]), 1e-3), float(w[1])
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, folds: int = 5, held_out: int = 0) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    The score depends on the text alone; null texts score as empty ones.  Repeated rows
    each get their score.  An empty table gives an empty one.
    """
    ship(docs.sparkSession)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in K.slices(batches):
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(model.score(statistics(x.column("text"))))], ["doc_id", "score"])

    out = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(go, "doc_id long, score double")
    return out.select("doc_id", (learn.fold(folds=folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model does not reject, with their columns, in one scan of them."""
    model = fit(docs, labels)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in K.slices(batches):
            yield x.filter(pa.array(model.score(statistics(x.column("text"))) >= threshold))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(go, docs.withColumn("text", F.col("text").cast("string")).schema)
