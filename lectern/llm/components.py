"""Connected components of a large graph, by local contraction and alternating large-star and small-star steps.

Each task first contracts its own links to stars around their least nodes, in memory bounded by ``LINKS_A_TASK``; when
all links fit one task, that is the answer.  Beyond it each step replaces the links of a node by links to the least node
near it; after a number of rounds that grows with the logarithm of the longest chain every component is a star around
its least node.  Minima are combined before the shuffle and hubs meet their links in plain equi-joins, which Spark
splits where they are skewed.  Every round is written to the shared checkpoint folder, so lineage stays short and a lost
executor costs one round at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.runtime import cut, shuffle_width

MOST_ROUNDS = 60
LINKS_A_TASK = 500_000


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for all nodes of the links (a, b); the root is the least node that they reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while len(x):
        px, py = parent[x], parent[y]
        apart = px != py
        x, y, px, py = x[apart], y[apart], px[apart], py[apart]
        np.minimum.at(parent, np.maximum(px, py), np.minimum(px, py))
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above
    return nodes, nodes[parent]


def _contracted(batches):
    """Links (node, root) of a task -> links of each node to the least node that it reaches within the task."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def folded():
        node, root = contract(*(np.concatenate([x[k] for x in held]) for k in range(2)))
        other = node != root
        return node[other], root[other]

    for batch in batches:
        held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)))
        size += len(batch)
        if size > 4 * LINKS_A_TASK:
            held = [folded()]
            size = len(held[0][0])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in folded()], names=["node", "root"])


def _toward_least(links: DataFrame, tasks: int, above: bool = False) -> DataFrame:
    """(u, v) with u the centre -> every v, or those above u, linked to the least of u and its v's: (node, root)."""
    least = links.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).select("c", F.least("c", "m").alias("m"))
    met = (links.where(F.col("v") > F.col("u")) if above else links).join(least.coalesce(tasks), F.col("u") == F.col("c"))
    return met.select(F.col("v").alias("node"), F.col("m").alias("root")).coalesce(tasks)


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """(a, b) pairs of ids -> (node, root) for every node whose component's least id, root, is another node.

    Nodes without links, or that are the least of their component, are not returned.  Null ids and loops are ignored.
    The number of tasks follows the number of links, so that a small graph in a large job costs little.
    """
    width = shuffle_width(links.sparkSession)
    now = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = cut(now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")))
    tasks = max(1, min(width, -(-now.count() // LINKS_A_TASK)))
    now = cut(now.coalesce(tasks).mapInArrow(_contracted, "node long, root long"))
    if tasks == 1:
        return now
    before = _fingerprint(now)
    for _ in range(MOST_ROUNDS):
        tasks = max(1, min(width, -(-before[0] // LINKS_A_TASK)))
        now = now.coalesce(tasks)
        both = now.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(now.select(F.col("root").alias("u"), F.col("node").alias("v"))).coalesce(tasks)
        small = _toward_least(both, tasks, above=True).distinct().coalesce(tasks).select(F.col("node").alias("u"), F.col("root").alias("v"))
        near = _toward_least(small, tasks).unionByName(small.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).coalesce(tasks))
        now = cut(near.where(F.col("node") != F.col("root")).coalesce(tasks).distinct().coalesce(tasks))
        after = _fingerprint(now)
        if after == before:
            return now
        before = after
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
