"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import settle

#: Edges that one task may hold (16 bytes each, and a table entry for each node).
TASK_EDGES = 400_000


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component) of all ends of ``edges`` (a, b); a component is its smallest node.

    Rounds of large-star and small-star turn the edges into stars. Once the
    edges are few enough for one task, that task ends it by union-find.
    Edges from a node to itself are kept as nodes of their own. The least of each
    node is staged before it is joined: both sides are then plain exchanges, so
    the edges of a hub can be split over several tasks.
    """
    own = edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    own = settle(own, "edges")
    n, before = own.count(), None
    while n > task_edges:
        own = settle(small_star(large_star(own)), "edges")
        n, mark = own.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if (n, mark) == before:
            return own.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                own.select("b", "b")
            ).groupBy("node").agg(F.min("component").alias("component"))
        before = n, mark
    return own.coalesce(1).mapInArrow(union_find, "node long, component long")


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v")
    least = settle(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.filter("v >= u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = settle(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    near = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return near.union(least.select("u", "m")).distinct()


def union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for low in range(0, len(nodes), 10_000):
        some = nodes[low : low + 10_000]
        columns = [pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["node", "component"])
