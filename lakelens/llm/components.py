"""Connected components of a link table: forests within tasks, then alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelens.llm.shared import Workspace

#: Links of one task, which bounds its memory.
TASK_LINKS = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of the links' nodes, by hooking and pointer jumping."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        for side in (root[x], root[y], x, y):
            np.minimum.at(root, side, low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            return nodes, nodes[root]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("v").to_numpy(), b.column("u").to_numpy()) for b in batches]
    if held:
        node, root = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        on = node != root
        yield pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(root[on])], names=["v", "u"])


def components(work: Workspace, links: DataFrame, each: int = TASK_LINKS) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of the links (a, b), a kept table.

    Links are dealt to tasks of about `each`, each of which replaces its own by a forest of stars. If
    that took one task, it is the result. Else star steps go on over what is left: each moves links to the
    smallest neighbour of a node, found with partial aggregation; a hub's links are dealt by the other end.
    The number of steps grows with the logarithm of the longest chain.
    """
    edges = work.keep(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u < v"), "links")
    tasks = max(1, -(-edges.count() // each))
    edges = work.keep(edges.repartition(tasks).mapInArrow(_contract, "v long, u long"), "forest")
    before = None
    while tasks > 1:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m"))
        large = both.filter("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.*").filter("u < v").distinct()
        edges = work.keep(small, "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.countDistinct("v")).first())
        if now == before or now[0] == 0:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return work.keep(roots.unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()), "roots")
