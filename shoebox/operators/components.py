"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, saved, ship

#: Edges that one task joins in memory; a larger graph is dealt to more tasks.
TASK_EDGES = 1 << 20


def _order(ids: np.ndarray) -> np.ndarray:
    """A fixed shuffle of 64-bit ids: contraction towards shuffled ids shrinks chains of ascending ids too."""
    h = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the root of each one's tree, the node of its component that comes first in the shuffled order.

    All edges are united at once: the later root of an edge is hung under the earlier one,
    then all paths are compressed.  At least half of the roots that still have an edge go
    in a round, so rounds are logarithmic.
    """
    nodes = np.unique(np.concatenate([a, b]))
    rank = np.empty(nodes.size, np.int64)
    order = np.argsort(_order(nodes), kind="stable")
    rank[order] = np.arange(nodes.size)
    a, b = rank[np.searchsorted(nodes, a)], rank[np.searchsorted(nodes, b)]
    parent = np.arange(nodes.size)
    while a.size:
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return nodes, nodes[order[parent[rank]]]


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of a task's edges; memory stays in proportion to the nodes, as full buffers are contracted."""
    held: list[np.ndarray] = []
    size = 0

    def contracted() -> np.ndarray:
        both = np.concatenate(held, axis=1)
        return np.stack(union_find(both[0], both[1]))

    for x in batches:
        held.append(np.stack([x.column(0).to_numpy(), x.column(1).to_numpy()]))
        size += x.num_rows
        if size > 2 * TASK_EDGES:
            held = [contracted()]
            size = held[0].shape[1]
    if held:
        node, root = contracted()
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b", task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, label): the smallest node reachable over undirected edges, for nodes with an edge.

    Each task unites its edges by union-find and gives a row per node with its root.  A
    node with several roots, from several tasks, joins the first of them and leaves the
    graph; its other roots become edges of the contracted graph, whose nodes are roots
    alone.  So the table shrinks every round, is dealt to as many tasks as it fills, and is
    done in one round where it fills one.  Labels are then read back through the rounds.
    Ids are 64-bit integers; null ids and loops are no edges; no edges give no rows.
    """
    spark = edges.sparkSession
    ship(spark)
    e = saved(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v"), "edges")
    rounds: list[DataFrame] = []
    while True:
        tasks = -(-e.count() // task_edges)
        dealt = e.coalesce(1) if tasks <= 1 else e.repartition(tasks, "u")
        trees = dealt.mapInArrow(_trees, "node long, root long")
        if tasks <= 1:
            rounds.append(saved(trees, "joined"))
            forget(e)
            break
        trees = saved(trees, "trees")
        first = F.min(F.struct(F.xxhash64("root"), "root"))["root"]
        joined = saved(trees.groupBy("node").agg(first.alias("root")), "joined")
        rest = trees.join(joined.withColumnRenamed("root", "to"), "node").where("root <> to").select(F.col("root").alias("u"), F.col("to").alias("v"))
        rest = saved(rest.distinct(), "edges")
        forget(trees)
        forget(e)
        rounds.append(joined)
        e = rest
    labels = rounds.pop()
    while rounds:
        step = labels.select(F.col("node").alias("root"), F.col("root").alias("to"))
        labels = rounds.pop().join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    least = labels.groupBy("root").agg(F.min("node").alias("label"))
    return saved(labels.join(least, "root").select("node", "label"), "labels")
