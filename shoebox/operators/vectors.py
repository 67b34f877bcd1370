"""Exact nearest neighbours and similarity edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dot, vector
from ..session import saved, ship
from . import pivots

#: Vectors of a block of the self-join; two blocks are in memory at once, 66 MB of 512 doubles, and the products of ROWS vectors with a block.
BLOCK, ROWS = 8192, 512
#: Edges of a pair of blocks that are held before all but the best go.
HELD = 1 << 21
#: From so many vectors on, joins are pruned by pivots.
PRUNED = 1 << 17
#: Blocks above which those of a pruned join grow, up to BLOCK vectors: a vector is sent once for each block that it meets.
BLOCKS = 64
#: Pairs of blocks up to which they are sent to the vectors; a file's size says little of them, as they compress well.
SENT = 1 << 16


def scored(vectors: DataFrame, query: list[float], embedding: str = "embedding") -> DataFrame:
    """Cosine with one unit vector, in doubles, inside the JVM."""
    return vectors.withColumn("score", F.round(dot(F.col(embedding), vector(query)), 6))


def nearest(vectors: DataFrame, query: list[float], k: int, key: str, embedding: str = "embedding") -> DataFrame:
    """The k best by score, then key, over the whole library: a top-k without a full sort."""
    return scored(vectors, query, embedding).orderBy(F.desc("score"), key).limit(k)


def knn_then_filter(vectors: DataFrame, query: list[float], limit: int, rows: DataFrame, key: str, embedding: str = "embedding") -> DataFrame:
    """k = max(8 * limit, 200) nearest of all, then those in `rows`, then the best: may return fewer than limit."""
    best = nearest(vectors, query, max(8 * limit, 200), key, embedding)
    return best.join(rows, key, "left_semi").orderBy(F.desc("score"), key).limit(limit)


def filter_then_knn(vectors: DataFrame, query: list[float], limit: int, rows: DataFrame, key: str, embedding: str = "embedding") -> DataFrame:
    """The exact counterpart: the nearest of those in `rows`."""
    return nearest(vectors.join(rows, key, "left_semi"), query, limit, key, embedding)


def similar_to(vectors: DataFrame, ident, k: int, key: str, embedding: str = "embedding") -> DataFrame:
    """Nearest to a stored vector, itself included; nothing where it has none."""
    one = vectors.where(F.col(key) == F.lit(ident)).select(F.col(embedding).alias("__q")).limit(1)
    score = F.round(dot(F.col(embedding), F.col("__q")), 6)
    return vectors.join(F.broadcast(one)).withColumn("score", score).drop("__q").orderBy(F.desc("score"), key).limit(k)


def put(vectors: DataFrame, new: DataFrame, key: str = "asset_id") -> DataFrame:
    """Vectors with those of the assets in `new` replaced."""
    return vectors.join(new.select(key), key, "left_anti").unionByName(new)


def of(vectors: DataFrame, ident, key: str = "asset_id") -> DataFrame:
    """The vector of an asset, or nothing."""
    return vectors.where(F.col(key) == F.lit(ident)).limit(1)


def _products(table: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, keys, scores) of the pairs of two blocks, or of one with itself, that reach the threshold, by some rows of the first at a time."""
    first = table.filter(pa.compute.field("side") == 1)
    second = table.filter(pa.compute.field("side") == 2)
    if not second.num_rows:  # a block with itself
        second = first
    a, b = pivots.matrix(first.column("v")), pivots.matrix(second.column("v"))
    p, q = first.column("key").to_numpy(), second.column("key").to_numpy()
    for at in range(0, len(a) if len(b) else 0, ROWS):
        scores = a[at : at + ROWS] @ b.T
        i, j = np.nonzero(scores >= threshold - 1e-6)
        score = np.round(scores[i, j], 6)
        keep = (score >= threshold) & (p[at + i] != q[j] if second is not first else p[at + i] < q[j])
        yield p[at + i[keep]], q[j[keep]], score[keep]


def _pairs(threshold: float):
    """Edges leave by ROWS vectors, so a task holds the edges of as many with one block."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, q, s in _products(pa.Table.from_batches(batches), threshold):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(s)], ["a", "b", "score"])

    # Spark reads the hints, which are names here
    go.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return go


def _best(source: np.ndarray, target: np.ndarray, score: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best `top` rows of each source, by score, then target."""
    order = np.lexsort((target, -score, source))
    source, target, score = source[order], target[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]])) if source.size else np.zeros(0, np.int64)
    keep = np.arange(source.size) - np.repeat(first, np.diff(np.append(first, source.size))) < top
    return source[keep], target[keep], score[keep]


def _tops(threshold: float, top: int):
    def go(table: pa.Table) -> pa.Table:
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        size = 0
        for p, q, s in _products(table, threshold):
            held += [(p, q, s), (q, p, s)]
            size += 2 * p.size
            if size > HELD:  # what is below the best goes before too much is held
                held, size = [_best(*map(np.concatenate, zip(*held, strict=True)), top)], 0
        held = _best(*map(np.concatenate, zip(*held, strict=True)), top)
        return pa.table(dict(zip(("source", "target", "score"), held, strict=True)))

    return go


def _met(vectors: DataFrame, threshold: float, key: str, embedding: str, block: int, count: int | None) -> DataFrame | None:
    """(key, v, i, j, side): the vectors of each pair of blocks that may hold a pair; None without vectors.

    count: pivots of a pruned join; None chooses, 0 compares all blocks.  Blocks of a pruned
    join have `block` vectors or, in a larger table, more.
    """
    ship(vectors.sparkSession)
    v = vectors.where(F.col(embedding).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(embedding).cast("array<double>").alias("v"))
    total = v.count()
    if count is None:
        count = min(pivots.PIVOTS, total // block) if total >= PRUNED else 0
    if count:
        some = pivots.choose(v, count)
        if not len(some):
            return None
        dealt, spans = pivots.blocks(vectors, key, embedding, some, max(block, min(BLOCK, total // BLOCKS)))
        pairs = saved(pivots.admitted(spans, threshold), "admitted")
        own = lambda side, number: pairs.select(F.col(side).alias("block"), "i", "j", F.lit(number).alias("side"))
        meet = own("i", 1).unionByName(own("j", 2).where("i < j"))
        meet = F.broadcast(meet) if pairs.count() <= SENT else meet.hint("merge")
        return dealt.join(meet, "block").select("key", "v", "i", "j", "side")
    cores = v.sparkSession.sparkContext.defaultParallelism
    n = max(-(-total // block), min(int((2 * cores) ** 0.5), -(-total // ROWS)), 1)
    v = v.withColumn("h", F.pmod(F.xxhash64("key"), F.lit(n)))
    meet = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: F.struct(F.least("h", x).alias("i"), F.greatest("h", x).alias("j"), F.when(F.col("h") <= x, 1).otherwise(2).alias("side")))
    met = v.select("key", "v", F.explode(meet).alias("m")).select("key", "v", "m.*")
    pairs = n * (n + 1) // 2
    # few pairs of large blocks: so that no two of them share a task while others have none
    return met.repartition(4 * pairs, "i", "j") if total > block and pairs < 4 * cores else met


def sim_edges(vectors: DataFrame, threshold: float, key: str, embedding: str = "embedding", block: int = BLOCK, count: int | None = None) -> DataFrame:
    """(a, b, score), a < b: all pairs of unit vectors with a cosine of at least the threshold.

    Vectors are dealt to blocks, and a pair of blocks is multiplied in a task, so memory is
    two blocks whatever the library.  A vector is copied once for each block that its own
    one meets.  In a library of less than PRUNED vectors, blocks are dealt by a hash and all
    meet, as large as memory lets them be; in a larger one, or if `count` pivots are asked
    for, only those that the pivots don't rule out.  Null vectors have no edges.  All
    vectors have one length.
    """
    met = _met(vectors, threshold, key, embedding, block, count)
    if met is None:
        return vectors.sparkSession.createDataFrame([], "a long, b long, score double")
    return met.groupBy("i", "j").applyInArrow(_pairs(threshold), "a long, b long, score double")


def top_edges(vectors: DataFrame, threshold: float, key: str, top: int = 24, embedding: str = "embedding", block: int = BLOCK, count: int | None = None) -> DataFrame:
    """The rows of `capped(sim_edges(...), top)`: a pair of blocks gives each vector's best `top` alone, so rows don't grow with the square of a group of copies."""
    met = _met(vectors, threshold, key, embedding, block, count)
    if met is None:
        return vectors.sparkSession.createDataFrame([], "source long, target long, score double, rn long")
    return _ranked(met.groupBy("i", "j").applyInArrow(_tops(threshold, top), "source long, target long, score double"), top)


def directed(edges: DataFrame) -> DataFrame:
    """Each edge both ways: source, target, score."""
    return edges.selectExpr("a source", "b target", "score").unionByName(edges.selectExpr("b source", "a target", "score"))


def _ranked(edges: DataFrame, top: int) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(F.desc("score"), "target")
    return edges.withColumn("rn", F.row_number().over(w).cast("long")).where(F.col("rn") <= top)


def capped(edges: DataFrame, top: int = 24) -> DataFrame:
    """The best `top` edges of each source with their rank; an edge may stay in one direction alone."""
    return _ranked(directed(edges), top)
