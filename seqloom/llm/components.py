"""Connected components of an edge table by alternating star operations, with written tables between rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, written


#: Edges that one task contracts: 4 MB of rows, and as much again for each of its few arrays.
EDGES = 1 << 18


def least_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (u, v), and the least node that each is connected with: roots hook on to smaller roots, then all point to their root."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    up = np.arange(len(nodes))
    while len(a):
        x, y = up[a], up[b]
        apart = x != y
        a, b = a[apart], b[apart]
        np.minimum.at(up, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(further := up[up], up):
            up = further
    return nodes, nodes[up]


def contracted(edges: DataFrame, tasks: int) -> DataFrame:
    """(u, v) from each node of a task's edges to the least node that those edges connect it with; files are dealt to tasks, no shuffle."""

    def run(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        nodes, root = least_roots(*(np.concatenate([x[i] for x in got] or [np.zeros(0, np.int64)]) for i in (0, 1)))
        moved = np.flatnonzero(nodes != root)
        for i in range(0, len(moved), 1 << 16):
            at = moved[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(root[at])], ["u", "v"])

    return edges.coalesce(tasks).mapInArrow(lean(run), "u long, v long")


def _tasks(rows: int) -> int:
    return max(1, -(-rows // EDGES))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b), both long; root is the least node of its component.

    A round makes each node's larger neighbours point to its least one, then its smaller ones. All is grouped by partial
    minima and joined back, so a node of very many neighbours is no large group anywhere. Loops and repeats are ignored.
    Before each round, every EDGES of the written edges are contracted by one task, which saves most rounds; edges that
    are few enough for one task need none.
    """
    edges = edges.select("a", "b")
    tasks = _tasks(edges.count())
    star, last = written(contracted(edges, tasks), "star"), None
    while tasks > 1:
        mark = star.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if mark == last:
            break
        last = mark
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = written(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "small")
        tasks = _tasks(small.count())
        star = written(contracted(small, tasks), "star")
    return star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
