"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so links stay distributed; a node with very many
links is one group in a partial aggregate. Each round is settled in the shared checkpoint
folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weighyard.llm.common import release, settle

#: Links that a task joins at a time.
TASK_LINKS = 1 << 17


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links to the smallest neighbour instead: those of larger neighbours, or of smaller ones."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of `links` (a, b); the component is its smallest node.

    Links may be repeated, reversed or point to themselves. Ids are longs, nulls are left out.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    edges, state = settle(edges.distinct()), None
    while True:
        for large in (True, False):
            edges = _star(edges, large).where("u > v").distinct()
        edges = settle(edges)
        release(edges.sparkSession)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node within reach) of all nodes of the links."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, top = at[:len(a)], at[len(a):], np.arange(len(nodes))
    while True:
        low, high = np.minimum(top[u], top[v]), np.maximum(top[u], top[v])
        if np.array_equal(low, high):
            return nodes, nodes[top]
        np.minimum.at(top, high, low)
        while not np.array_equal(above := top[top], top):
            top = above


def contracted(links: DataFrame, tasks: int) -> DataFrame:
    """Links (a, b) with the same components: a task's links, TASK_LINKS at a time, become stars."""
    def run(batches):
        def star():
            table = pa.Table.from_batches(gathered)
            return pa.RecordBatch.from_arrays(
                [pa.array(x) for x in stars(table["a"].to_numpy(), table["b"].to_numpy())], names=["a", "b"])

        gathered, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, TASK_LINKS):
                part = batch.slice(at, TASK_LINKS)
                if gathered and n + part.num_rows > TASK_LINKS:
                    yield star()
                    gathered, n = [], 0
                gathered.append(part)
                n += part.num_rows
        if n:
            yield star()

    return links.coalesce(tasks).mapInArrow(run, "a long, b long")


def task_components(links: DataFrame) -> DataFrame:
    """`components`, for links that are few for Spark: tasks join their own first, and links that fit one task are done."""
    links = settle(links.select("a", "b").where("a <> b"))
    tasks = -(-links.count() // TASK_LINKS)
    if tasks > 1:
        return components(contracted(links, tasks))
    return settle(contracted(links, 1)).toDF("node", "component")
