"""Exact similarity search that skips what the triangle inequality rules out.

Some vectors of the table are pivots.  A block of vectors is described by the least and the
greatest angle that its members have to each pivot.  Whatever lies outside of such an
interval by more than an angle is farther than that angle from all of the block, so blocks
are left unread, and pairs of blocks unmultiplied, without losing a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import dot, vector
from ..session import saved, ship

#: Pivots, and vectors of a block; a block's description is two numbers a pivot.
PIVOTS, BLOCK = 64, 4096
#: Scores are rounded to six places and vectors have unit length but for this; in radians, the error of an angle.
LOOSE, SLACK = 2e-5, 1e-5


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    v = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return v.flatten().to_numpy().reshape(len(v), -1) if len(v) else np.zeros((0, 1))


def choose(vectors: DataFrame, count: int) -> np.ndarray:
    """Pivots: vectors in the order of a hash, then those of them that are far from the ones before (at most `count`)."""
    rows = vectors.orderBy(F.xxhash64("key"), "key").limit(8 * count).select("v").collect()
    some = np.array([r.v for r in rows], float)
    norms = np.linalg.norm(some, axis=1) if len(some) else np.zeros(0)
    some = some[norms > 0] / norms[norms > 0, None]
    if not len(some):
        return some
    picked, near = [0], some @ some[0]
    while len(picked) < min(count, len(some)):
        k = int(near.argmin())
        if near[k] > 1 - 1e-9:
            break
        picked.append(k)
        near = np.maximum(near, some @ some[k])
    return some[picked]


def angles(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(v @ pivots.T, -1, 1))


def _place(pivots: np.ndarray):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                a = angles(matrix(x.column("v")), pivots)
                cell = a.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([x.column("key"), x.column("v"), pa.array(cell.astype(np.int32)), pa.array(a[np.arange(len(a)), cell])], ["key", "v", "cell", "far"])

    return go


def _spans(pivots: np.ndarray):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                v, block = matrix(x.column("v")), x.column("block").to_numpy()
                a = angles(v, pivots)
                odd = np.abs(np.linalg.norm(v, axis=1) - 1) > LOOSE / 4  # the angles of such a vector say nothing of its products
                order = np.argsort(block, kind="stable")
                own, first = np.unique(block[order], return_index=True)
                lo = np.minimum.reduceat(np.where(odd[:, None], 0, a)[order], first, axis=0)
                hi = np.maximum.reduceat(np.where(odd[:, None], np.pi, a)[order], first, axis=0)
                n = np.diff(np.append(first, len(order)))
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n), pa.array(lo.tolist(), pa.list_(pa.float64())), pa.array(hi.tolist(), pa.list_(pa.float64()))], ["block", "n", "lo", "hi"])

    return go


def blocks(vectors: DataFrame, key: str, embedding: str, pivots: np.ndarray, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(key, v, block) and (block, n, lo, hi), both written down.

    A cell is what has the same nearest pivot; cells are cut into shells by the angle to it,
    and shells, where many vectors are alike, into parts by a hash, so no block is much
    larger than asked for, whatever the vectors.
    """
    ship(vectors.sparkSession)
    v = vectors.where(F.col(embedding).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(embedding).cast("array<double>").alias("v"))
    placed = saved(v.mapInArrow(_place(pivots), "key long, v array<double>, cell int, far double"), "placed")
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("far", [k / 64 for k in range(1, 64)], 10_000).alias("cuts"))
    shells = F.least(F.ceil(F.col("n") / block), F.lit(64))  # a row a pivot
    step = F.expr("transform(sequence(1, 63), k -> struct(k as k, element_at(cuts, k) as at))")
    cuts = cells.withColumn("shells", shells).withColumn("cuts", F.transform(F.filter(step, lambda x: F.floor(x["k"] * F.col("shells") / 64) > F.floor((x["k"] - 1) * F.col("shells") / 64)), lambda x: x["at"]))
    shell = F.size(F.filter("cuts", lambda c: c < F.col("far")))
    ringed = placed.join(F.broadcast(cuts.select("cell", "cuts")), "cell").select("key", "v", (F.col("cell") * 64 + shell).alias("shell"))
    sizes = ringed.groupBy("shell").agg(F.ceil(F.count("*") / block).alias("parts"))  # at most 64 rows a pivot
    part = F.pmod(F.xxhash64("key"), F.col("parts"))
    dealt = saved(ringed.join(F.broadcast(sizes), "shell").select("key", "v", (F.col("shell").cast("long") * (1 << 32) + part).alias("block")), "dealt")
    return dealt, saved(spans(dealt, pivots), "spans")


def spans(dealt: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(block, n, lo, hi): the angles that a block's members have to each pivot."""
    rows = dealt.select("block", "v").mapInArrow(_spans(pivots), "block long, n long, lo array<double>, hi array<double>")
    each = lambda f, name: F.array(*[f(F.col(name)[k]) for k in range(len(pivots))]).alias(name)
    return rows.groupBy("block").agg(F.sum("n").alias("n"), each(F.min, "lo"), each(F.max, "hi"))


def widest(score: float) -> float:
    """The greatest angle at which a rounded product of the score may be."""
    return float(np.arccos(np.clip(score - LOOSE, -1, 1))) + SLACK


def apart(lo: Column, hi: Column, at: list[float]) -> Column:
    """The least angle that a vector with these angles to the pivots has to anything in the block."""
    out = F.zip_with(lo, F.array(*map(F.lit, at)), lambda a, b: a - b), F.zip_with(F.array(*map(F.lit, at)), hi, lambda a, b: a - b)
    return F.greatest(F.array_max(out[0]), F.array_max(out[1]), F.lit(0.0))


def _gap(a: str, b: str) -> Column:
    """The least angle between members of two blocks (structs of lo and hi) that the pivots allow."""
    between = lambda x, y: F.array_max(F.zip_with(F.col(f"{x}.lo"), F.col(f"{y}.hi"), lambda p, q: p - q))
    return F.greatest(between(a, b), between(b, a))


def admitted(spans: DataFrame, score: float) -> DataFrame:
    """(i, j), i <= j: pairs of blocks in which two vectors may have a product of the score.

    Cells, as many as pivots, are compared on the driver; blocks of the pairs of cells that
    are left meet in a join.
    """
    angle = widest(score)
    size = len(spans.first().lo)
    each = lambda f, name: F.array(*[f(F.col(name)[k]) for k in range(size)]).alias(name)
    cell = F.expr("cast(shiftright(block, 32) div 64 as int)")
    cells = spans.groupBy(cell.alias("cell")).agg(each(F.min, "lo"), each(F.max, "hi")).orderBy("cell").collect()
    lo, hi = np.array([c.lo for c in cells]), np.array([c.hi for c in cells])
    near = [(c.cell, cells[k].cell) for n, c in enumerate(cells) for k in np.flatnonzero(np.maximum(lo - hi[n], lo[n] - hi).max(axis=1) <= angle)]
    pairs = F.broadcast(spans.sparkSession.createDataFrame(near, "p int, q int"))
    first = spans.select(cell.alias("p"), F.struct("block", "lo", "hi").alias("a"))
    second = spans.select(cell.alias("q"), F.struct("block", "lo", "hi").alias("b"))
    met = first.join(pairs, "p").join(second, "q").where("a.block <= b.block").where(_gap("a", "b") <= angle)
    return met.select(F.col("a.block").alias("i"), F.col("b.block").alias("j"))


# --- nearest neighbours -------------------------------------------------------------------


def build(vectors: DataFrame, path: str, key: str, embedding: str = "embedding", count: int = PIVOTS, block: int = BLOCK) -> None:
    """Write an index: vectors by block, the blocks' descriptions and the pivots. Vectors are of unit length; null ones are left out."""
    v = vectors.where(F.col(embedding).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(embedding).cast("array<double>").alias("v"))
    pivots = choose(v, count)
    spark = vectors.sparkSession
    spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(pivots)], "k int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")
    if not len(pivots):
        pivots = np.ones((1, 1))
    dealt, described = blocks(vectors, key, embedding, pivots, block)
    dealt.repartition("block").write.mode("overwrite").partitionBy("block").parquet(f"{path}/vectors")
    described.coalesce(1).write.mode("overwrite").parquet(f"{path}/spans")


def scored(spark: SparkSession, path: str, some: list[int], query: list[float]) -> DataFrame:
    rows = spark.read.schema("key long, v array<double>").parquet(*(f"{path}/vectors/block={b}" for b in some))
    return rows.select("key", F.round(dot(F.col("v"), vector(query)), 6).alias("score"))


def search(spark: SparkSession, path: str, query: list[float], k: int) -> tuple[DataFrame, int]:
    """(key, score) of the k best by score, then key, and how many blocks were read; exact.

    The nearest blocks that hold k vectors give a k-th score; every other block that may
    hold as good a one is read as well, and no more.
    """
    pivots = np.array([r.v for r in spark.read.parquet(f"{path}/pivots").orderBy("k").collect()])
    none = spark.createDataFrame([], "key long, score double")
    if not len(pivots) or k < 1:
        return none, 0
    q = np.array(query, float)
    norm = float(np.linalg.norm(q))
    if abs(norm - 1) > LOOSE / 4:
        raise ValueError("the query must have unit length")
    at = angles(q[None], pivots)[0].tolist()
    bound = spark.read.parquet(f"{path}/spans").select("block", "n", apart(F.col("lo"), F.col("hi"), at).alias("apart"))
    # the blocks nearest by bound: each holds a vector at least, so k of them suffice
    order = bound.orderBy("apart", "block").limit(k).collect()
    some, held = [], 0
    for r in order:
        some.append(r.block)
        held += r.n
        if held >= k:
            break
    best = scored(spark, path, some, query).orderBy(F.desc("score"), "key").limit(k).collect()
    if len(best) == k:
        more = [r.block for r in bound.where(F.col("apart") <= widest(best[-1].score)).select("block").collect()]
    else:
        more = [r.block for r in bound.select("block").collect()]
    more = sorted(set(more) - set(some))
    first = spark.createDataFrame([(r.key, r.score) for r in best], none.schema)  # k rows
    rows = first.unionByName(scored(spark, path, more, query)) if more else first
    return rows.orderBy(F.desc("score"), "key").limit(k), len(some) + len(more)


def _heap(anchors: np.ndarray, k: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [np.zeros(0, np.int64)] * len(anchors)
        best = [np.zeros(0)] * len(anchors)
        for x in batches:
            own = x.column("key").to_numpy()
            for n, score in enumerate(np.round(matrix(x.column("v")) @ anchors.T, 6).T if x.num_rows else []):
                every, names = np.concatenate([best[n], score]), np.concatenate([keys[n], own])
                if every.size > k:
                    least = np.partition(every, every.size - k)[every.size - k]
                    every, names = every[every >= least], names[every >= least]
                    order = np.lexsort((names, -every))[:k]
                    every, names = every[order], names[order]
                best[n], keys[n] = every, names
        n = np.repeat(np.arange(len(anchors), dtype=np.int32), [len(b) for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(np.concatenate(keys)), pa.array(np.concatenate(best))], ["anchor", "key", "score"])

    return go


def nearest_many(vectors: DataFrame, anchors: list[list[float]], k: int, key: str, embedding: str = "embedding") -> DataFrame:
    """(anchor, key, score, rn): the k best of each anchor by score, then key, in one scan; a task keeps k rows an anchor."""
    from pyspark.sql import Window

    ship(vectors.sparkSession)
    v = vectors.where(F.col(embedding).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(embedding).cast("array<double>").alias("v"))
    rows = v.mapInArrow(_heap(np.array(anchors, float), k), "anchor int, key long, score double")
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "key")  # k rows a task
    return rows.withColumn("rn", F.row_number().over(best).cast("long")).where(F.col("rn") <= k)
