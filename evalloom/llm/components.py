"""Connected components of links, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.common import cut


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges (a, b) but the smallest of its component, with that smallest one."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    rest = root != np.arange(len(nodes))
    return nodes[rest], nodes[root[rest]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task, folded into a forest now and then."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for x in batches:
        a, b = np.r_[a, x.column(0).to_numpy(zero_copy_only=False)], np.r_[b, x.column(1).to_numpy(zero_copy_only=False)]
        if len(a) > 200_000:
            a, b = forest(a, b)
            if len(a) > 150_000:  # it doesn't fold: hand it on
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                a, b = a[:0], b[:0]
    if len(a):
        a, b = forest(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


#: Links that one task may fold at once (32 MB), if there are no more; a larger number takes rounds of many tasks.
ONE_TASK = 2_000_000


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links of a task as one forest: (node, root)."""
    parts = [(x.column(0).to_numpy(zero_copy_only=False), x.column(1).to_numpy(zero_copy_only=False)) for x in batches]
    if any(len(a) for a, _ in parts):
        a, b = forest(np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["node", "root"])


def components(links: DataFrame, most_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root): of the links (a, b), each node but the roots, with its component's smallest node.

    Tasks fold their own links first. What is left is folded in one task if it is small, which is counted;
    else large-star and small-star steps alternate until it is or nothing moves. Nodes without a link, and
    links from a node to itself, give no row.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    edges = cut(edges.mapInArrow(_local, "a long, b long").distinct())
    for _ in range(most_rounds):
        if edges.count() <= one_task:
            return cut(edges.coalesce(1).mapInArrow(_whole, "node long, root long"))
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        new = cut(small)
        # done when each node has one root and no root has one itself
        bad = new.groupBy("a").count().filter("count > 1").select("a").union(new.select(F.col("b").alias("a")).join(new.select("a"), "a", "left_semi"))
        done = bad.isEmpty()
        edges = new
        if done:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("components did not settle")
