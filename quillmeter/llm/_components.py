"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.llm._store import Store


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) for all nodes that are not their own smallest, of the edges a-b."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(both[: len(a)].tolist(), both[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    tops = np.fromiter((root(i) for i in range(len(nodes))), np.int64, len(nodes))
    away = np.flatnonzero(tops != np.arange(len(nodes)))
    return nodes[away], nodes[tops[away]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's edges become a forest of stars; long input is folded in pieces, so memory follows the nodes."""
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(a) > 500_000:
            a, b = forest(a, b)
    if len(a):
        a, b = forest(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])


def components(edges: DataFrame, store: Store, name: str = "components") -> DataFrame:
    """(node, component) for every node with an edge to another; component is the smallest node it reaches.

    edges has two long columns without nulls, in any direction, with repeats and loops allowed. Each round joins
    and groups by node with map-side combining, and is written to the shared folder; rounds grow with the logarithm
    of the longest chain.
    """
    a, b = (edges[c] for c in edges.columns)
    e = edges.where(a != b).select(a.alias("u"), b.alias("v")).mapInArrow(_contract, "u long, v long")
    e, mark, k = store.table(e, f"{name}-0"), None, 0
    while True:
        seen = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if seen == mark or seen[0] == 0:
            break
        mark, k = seen, k + 1
        both = e.select(F.col("u").alias("n"), F.col("v").alias("m")).union(e.select("v", "u"))
        low = both.groupBy("n").agg(F.least("n", F.min("m")).alias("lo"))
        large = both.join(low, "n").where("m > n and m <> lo").select(F.col("m").alias("u"), F.col("lo").alias("v"))
        low = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("lo"))
        small = large.join(low, large["u"] == low["w"])
        small = small.select(F.explode(F.array(F.struct("u", F.col("lo").alias("v")), F.struct(F.col("v").alias("u"), F.col("lo").alias("v")))).alias("e"))
        e = store.table(small.select("e.u", "e.v").where("u <> v").distinct(), f"{name}-{k}")
        store.drop(f"{name}-{k - 1}")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
