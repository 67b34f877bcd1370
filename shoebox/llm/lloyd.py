"""Plain Lloyd clustering of integer vectors, exact in every sum.

Components become integers once, by built-in functions, and are written down; each round
reads that table, compares every vector with every centroid in NumPy and sends one row of
sums per centroid and task to Spark, which merges them.  On the driver are the centroids
alone, k vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_tools import saved, ship

#: Integer components lie within plus and minus this, so that a squared distance of 64 of them fits a long.
LIMIT = 1 << 27
_LONG = (1 << 63) - 1
SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integers(vectors: DataFrame, dim: int, scale: int, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component of the vectors that have exactly `dim` of them, all finite."""
    e = F.col("e")
    v = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(e, lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(float(-LIMIT))), F.lit(float(LIMIT)))).cast("int"))
    return v.where((F.size(e) == dim) & ~odd).select("vec_id", whole.alias("v"))


def first_centroids(v: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors of the k smallest sha256 of `seed:id`, in that order: a top-k, k rows a task."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r.v for r in v.orderBy(mark.asc_nulls_last(), "v").limit(k).select("v").collect()], np.int64)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.concatenate(column.to_list()).astype(np.int64).reshape(len(column), -1)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smallest of several, and the squared distance."""
    far = np.empty((len(centroids), len(v)), np.int64)
    for c, at in enumerate(centroids):
        apart = v - at
        far[c] = np.einsum("ij,ij->i", apart, apart)
    who = far.argmin(axis=0)
    return who.astype(np.int32), far[who, np.arange(len(v))]


def _sums(centroids: np.ndarray) -> Callable:
    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for f in frames:
            if len(f):
                v = _matrix(f["v"])
                who = nearest(v, centroids)[0]
                order = np.argsort(who, kind="stable")
                present, first = np.unique(who[order], return_index=True)
                total[present] += np.add.reduceat(v[order], first, axis=0)
                n += np.bincount(who, minlength=len(centroids))
        seen = np.flatnonzero(n)
        yield pd.DataFrame({"cluster": seen.astype(np.int32), "sums": list(total[seen]), "n": n[seen]})

    return go


def _assign(centroids: np.ndarray) -> Callable:
    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                who, far = nearest(_matrix(f["v"]), centroids)
                yield pd.DataFrame({"vec_id": f["vec_id"].astype("Int64"), "cluster": who, "distance": far})

    return go


def moved(v: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: floors of the exact means; one without vectors stays."""
    rows = v.select("v").mapInPandas(_sums(centroids), "cluster int, sums array<long>, n long")
    exact = [F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(centroids.shape[1])]
    out = centroids.copy()
    for r in rows.groupBy("cluster").agg(F.array(*exact).alias("sums"), F.sum("n").alias("n")).collect():
        out[r.cluster] = [int(s) // r.n for s in r.sums]
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: str = "1", key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Each vector's cluster after `rounds` rounds, with squared distances and their sums.

    Vectors of another length than `dim`, null, or with a null or non-finite component are
    left out; other columns are ignored.  Rows that repeat an id are vectors of their own;
    a null id stays null, and such a vector starts as a centroid only where others don't
    suffice.  With fewer than k vectors there are as many centroids as vectors; an empty
    table gives an empty one.  Integers beyond +-2**27 count as that.  A sum of distances
    that no long can hold is null.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = saved(integers(vectors, dim, scale, key, embedding), "integers")
    centroids = first_centroids(v, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], SCHEMA)
    for _ in range(rounds):
        centroids = moved(v, centroids)
    rows = saved(v.mapInPandas(_assign(centroids), "vec_id long, cluster int, distance long"), "assigned")
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda x: x if x <= _LONG else None
    total = fits(sum(sums.values()))
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = spark.createDataFrame([(c, fits(s), total, marks[c]) for c, s in sorted(sums.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
