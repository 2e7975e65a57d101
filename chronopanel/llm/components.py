"""Connected components of an edge table, without a graph in one place.

Edges are first contracted inside partitions of bounded size, then large-star
and small-star rounds link every node to the smallest node it can reach.  Each
round's edges are a stored table.  The number of rounds grows with the logarithm
of the number of nodes; a hot node is a hot join key, which adaptive execution
splits, and its minimum is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.shared import stored

#: Edges contracted in one task on average.
TASK_EDGES = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the nodes of an edge list, without the smallest themselves."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = code[: len(a)], code[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        if np.array_equal(before, root):
            break
    inner = root != np.arange(len(nodes))
    return nodes[inner], nodes[root[inner]]


def _contract(edges: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is not None and len(table):
            u, v = forest(table.column("u").to_numpy(), table.column("v").to_numpy())
            for lo in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(u[lo : lo + 100_000]), pa.array(v[lo : lo + 100_000])], ["u", "v"])

    # Any dealing of the edges is right; by both ends a hot node is not one task.
    return edges.repartition(parts, "u", "v").mapInArrow(run, "u bigint, v bigint")


def connected(edges: DataFrame, label: str) -> DataFrame:
    """(node, root) for every node with an edge in columns u, v (bigint); root is the component's smallest node.

    Null ends and loops link nothing; repeated edges count once; no edges give no rows.
    """
    table = stored(edges.where("u <> v").select("u", "v"), label)
    total = table.count()
    parts = max(1, -(-total // TASK_EDGES))
    table = stored(_contract(table, parts), label)
    if parts == 1:
        # One bounded task has seen all edges: its forest is the answer.
        return _with_roots(table)
    while True:
        both = table.select("u", "v").union(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), label)
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, label)
        down = stored(large.groupBy("u").agg(F.min("v").alias("m")), label)
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        new = stored(small.where("u <> v").distinct(), label)
        state = [t.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 30)))).first() for t in (table, new)]
        table = new
        if state[0] == state[1]:
            return _with_roots(table)


def _with_roots(table: DataFrame) -> DataFrame:
    return table.select(F.col("u").alias("node"), F.col("v").alias("root")).union(table.select("v", "v").distinct())
