"""Connected components of a table of links: at the driver while they are few, by joins alone beyond."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readprep.llm.common import cut

#: Distinct links up to which the driver joins them: two longs each, 8 MB. Rounds of joins over so few would cost hundreds
#: of tasks and as many shuffle files each.
FEW = 500_000


def _lowest(edges: DataFrame) -> DataFrame:
    """(node, low): the smallest of a node and its neighbours; partial sums make this one row a node and task."""
    return edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("low"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def linked(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes in order, the smallest node that each one reaches) for the links u, v."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))  # a and b are roots: the larger one goes to a smaller one
        while not np.array_equal(root, up := root[root]):
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[root]


def components(links: DataFrame, most_rounds: int = 60, few: int = FEW) -> DataFrame:
    """(node, component) for every node of links (u, v); the component is its smallest node.

    Up to few links are joined at the driver. Of more, this alternates two star steps: every node hands its larger neighbours, then its smaller ones, to the smallest node it
    knows of. Paths shrink geometrically, so rounds grow with the logarithm of the longest path. A node with very many
    links is one large join key, which adaptive execution splits; nothing is gathered per node.
    """
    edges = cut(links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    if state[0] <= few:
        rows = edges.toArrow()
        node, component = linked(rows["u"].to_numpy(), rows["v"].to_numpy())
        return links.sparkSession.createDataFrame(pa.table({"node": pa.array(node, pa.int64()), "component": pa.array(component, pa.int64())}))
    for _ in range(most_rounds):
        if state[0] == 0:
            break
        both = _both(edges)
        large = both.join(_lowest(both), F.col("u") == F.col("node")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        # small step: neighbours of u at or below it, with u itself, go to the smallest of them
        low = large.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("low"))
        joined = large.join(low, F.col("u") == F.col("node"))
        small = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("low").alias("v")).where(F.col("u") != F.col("v")).distinct()
        edges = cut(small)
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Count and order-free checksum; equal before and after a round means nothing moved."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s
