"""Connected components, in memory for one task and over all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fotoloom.scratch import materialize

#: Edges that a task contracts at a time, and stars that one task settles at most (16 bytes each).
BUFFER = 1_000_000
ONE_TASK = 250_000


def label_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component, for edges a-b among nodes 0 to n - 1."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        if (la == lb).all():
            return label
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def spanning_forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The places of the edges of a minimum spanning forest of edges a-b, ties by place (Boruvka: each component takes its lightest edge
    to another one, until none is left)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    order = np.argsort(weight, kind="stable")
    u, v, edge = u[order], v[order], order
    label, chosen = np.arange(len(nodes)), []
    while True:
        x, y = label[u], label[v]
        apart = x != y
        u, v, edge, x, y = u[apart], v[apart], edge[apart], x[apart], y[apart]
        if not len(edge):
            break
        # In order of weight, so that the first edge of a component is its lightest.
        lightest = np.full(len(nodes), len(edge))
        np.minimum.at(lightest, x, np.arange(len(edge)))
        np.minimum.at(lightest, y, np.arange(len(edge)))
        take = np.unique(lightest[lightest < len(edge)])
        chosen.append(edge[take])
        label = label_components(len(nodes), np.concatenate([np.arange(len(nodes)), x[take]]), np.concatenate([label, y[take]]))
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) as stars (u, v), v the least node of each component, of `BUFFER` edges at a time."""
    held, count = [], 0

    def stars() -> pa.RecordBatch:
        a, b = (np.concatenate([np.asarray(h.column(c)) for h in held]) for c in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = nodes[label_components(len(nodes), at[: len(a)], at[len(a) :])]
        star = nodes != root
        return pa.RecordBatch.from_arrays([pa.array(nodes[star]), pa.array(root[star])], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= BUFFER:
            yield stars()
            held, count = [], 0
    if count:
        yield stars()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """`node` and `root` (the least node of its component) of every node with an edge to another one.

    Tasks first replace the edges they read by stars. Up to `one_task` of these are settled by one task. Of more, there are
    rounds of large-star and small-star: every round is a few aggregations by node that combine before their shuffle, and the
    number of rounds grows with the logarithm of the longest chain. Each round is cut off by a written table, and what
    tells whether it changed anything is observed while it is written.
    """

    def written(stars: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        table = materialize(stars.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), "stars")
        return table, (seen.get["n"], seen.get["x"])

    pairs = edges.where(F.col(a) != F.col(b)).select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    found, state = written(pairs.mapInArrow(_contracted, "u long, v long"))
    if state[0] <= one_task:
        found = found.coalesce(1).mapInArrow(_contracted, "u long, v long")
    before = state if state[0] <= one_task else None
    while state != before and state[0]:
        before = state
        both = found.unionAll(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        found, state = written(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
    return found.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(found.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
