"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.shared import drop_saved, save

#: Up to so many different edges are solved by one task; the components are the same.
EDGES_AT_ONCE = 100_000


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for the nodes of ``edges`` (a, b): the root is a component's smallest node.

    Each round hangs every node under the smallest of its neighbours, once among all and once
    among the smaller ones, until all edges point at roots. Joins and minima only: no node's
    neighbours are gathered, and as minima are written before they are joined, a node with very
    many edges can be split. Rounds are written to the shared folder, so that lineage stays
    short; the driver sees a few numbers a round. Up to EDGES_AT_ONCE edges are solved by one task instead.
    Loops and repeated edges are harmless.
    """
    edges = save(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if edges.count() <= EDGES_AT_ONCE:
        kind = edges.schema["u"].dataType.simpleString()
        return edges.coalesce(1).mapInArrow(_solved, f"node {kind}, root {kind}")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = save(large, "edges")
        lower = save(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(lower, "u").select("v", "m").where("v != m").withColumnsRenamed({"v": "u", "m": "v"})
        new = save(small.unionByName(lower.withColumnRenamed("m", "v")).distinct(), "edges")
        for saved in (edges, least, large, lower):
            drop_saved(saved)
        edges = new
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller one, and none beyond it."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    of = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return of.where("up > 1 OR up = 1 AND down = 1").isEmpty()


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of the edges of one task."""
    held = pa.Table.from_batches(found) if (found := list(batches)) else None
    if held is None or not len(held):
        return
    nodes = pa.concat_arrays([c for name in ("u", "v") for c in held[name].chunks])
    values = [tuple(x.values()) if isinstance(x, dict) else x for x in nodes.to_pylist()]
    n, first, root = len(held), {}, {}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, x in enumerate(values):
        first.setdefault(x, i)
        root.setdefault(x, x)
    for x, y in zip(values[:n], values[n:], strict=True):
        x, y = sorted((find(x), find(y)))
        root[y] = x
    take = pa.array(list(first.values()))
    yield pa.RecordBatch.from_arrays([nodes.take(take), nodes.take(pa.array([first[find(x)] for x in first]))], names=["node", "root"])
