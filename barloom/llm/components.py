"""Connected components of an edge table by hooking and pointer jumping.

In each round every node's parent is the smallest of its smaller neighbours. An edge to another neighbour is replaced by one from that neighbour to the
parent, and a node's edge to its parent by one to its parent's parent. Trees thus hook onto smaller ones and halve in depth; when nothing moves every
node points at the smallest of its component. The rounds needed grow with the logarithm of a component's size, and the number of edges never grows.
Minima are pre-aggregated before the shuffle; a hub's edges are rows of their own, joined with its one parent, so AQE can split them. Every round is
written to the shared folder and the one before it removed; only whether anything moved comes to the driver.

Each round is a few Spark jobs, whose stages and tasks the driver keeps a record of. With chunk, tasks first replace chunks of about as many edges by a star for each
component of the chunk, again while that halves the number of chunks. Edges of one chunk need no round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, scope


def _round(edges: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, after one round, and whether each has moved."""
    parents = edges.groupBy("a").agg(F.min("b").alias("m"))
    known = parents.select(F.col("a").alias("k"), F.col("m").alias("up"))
    hooks = edges.join(known.hint("merge"), F.col("a") == F.col("k")).filter("b <> up").select(F.col("b").alias("a"), F.col("up").alias("b"), F.lit(True).alias("moved"))
    jumps = parents.join(known.hint("merge"), F.col("m") == F.col("k"), "left").select("a", F.coalesce("up", "m").alias("b"), F.col("up").isNotNull().alias("moved"))
    return hooks.unionByName(jumps)


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges but the smallest of each component, and that smallest node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        up = root.copy()
        np.minimum.at(up, root[x], low)
        np.minimum.at(up, root[y], low)
        while (up[up] != up).any():
            up = up[up]
        if (up == root).all():
            break
        root = up
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _stars(edges: DataFrame, chunk: int, chunks: int) -> DataFrame:
    """Edges (a, b), a > b, with the components of edges: stars of the chunks."""

    def of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in star(table.column("a").to_numpy(), table.column("b").to_numpy())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= chunk:
                yield of(held)
                held, rows = [], 0
        if held:
            yield of(held)

    return edges.coalesce(chunks).mapInArrow(run, "a long, b long")


def components(edges: DataFrame, chunk: int | None = None) -> DataFrame:
    """edges (a, b) of longs, any direction, loops allowed -> (node, component) for every node of an edge between two.

    component is the smallest node reachable. Nodes without edges are not listed. chunk: edges that a task holds at once before the first round; None: no chunks.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b"))
    chunks = -(-edges.count() // chunk) if chunk else 0
    moved = chunks > 1 if chunk else not edges.isEmpty()
    while chunks:
        edges, before = materialize(_stars(edges, chunk, chunks)), chunks
        # stars are few edges, which may fit fewer chunks; where they don't, rounds do the rest
        chunks = -(-edges.count() // chunk) if before > 1 else 0
        moved = before > 1
        if chunks > before // 2:
            break
    while moved:
        with scope(edges.sparkSession) as kept:
            edges = materialize(_round(edges))
            kept.append(edges)
            moved = not edges.filter("moved").isEmpty()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
