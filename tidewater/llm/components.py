"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, mapped

#: Edges that a task contracts at a time.
HELD = 1 << 20


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); the root is the component's smallest node.

    Large stars link a node's larger neighbours to its smallest one, small stars do so with the smaller neighbours; then each
    task makes stars of what its own edges connect. The edge count never grows and the rounds follow the logarithm of the
    diameter; edges of one task need no round. Each round is a written table, so lost executors cost one round; only whether
    all are stars comes to the driver.
    """
    current, step = scratch.write(_contracted(_oriented(edges)), "edges-0"), 0
    while not _all_stars(current):
        step += 1
        following = scratch.write(_contracted(_small_star(_large_star(current))), f"edges-{step}")
        scratch.drop(f"edges-{step - 1}")
        current = following
    roots = current.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).distinct().unionByName(roots)


def _oriented(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller node."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that edges connect with a smaller one, and the smallest of those."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = places[: a.size], places[a.size :]
    label = np.arange(nodes.size)
    while True:  # the least place spreads over edges, and over places that have it already
        least = np.minimum(label[a], label[b])
        spread = label.copy()
        np.minimum.at(spread, a, least)
        np.minimum.at(spread, b, least)
        spread = spread[spread]
        if np.array_equal(spread, label):
            break
        label = spread
    moved = np.flatnonzero(label != np.arange(nodes.size))
    return nodes[moved], nodes[label[moved]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges that connect the same, where the edges of a task are stars; two tasks may have the same edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            a, b = stars(*np.concatenate(held, axis=1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in ("a", "b")]))
            size += batch.num_rows
            if size >= HELD:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return edges.select("a", "b").transform(mapped, run, "a long, b long")


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node has one smaller neighbour, or larger ones only."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.lit(None).cast("long").alias("to")))
    seen = ends.groupBy("node").agg(F.min("to").alias("least"), F.max("to").alias("most"), F.bool_or(F.col("to").isNull()).alias("below"))
    return seen.where("least <> most OR least IS NOT NULL AND below").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _oriented(moved.unionByName(least.select("a", F.col("m").alias("b"))))
