"""Connected components of a table of edges, by alternating large and small stars till few edges are left."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import checkpointed


#: As many edges as the driver joins itself: a round of stars is a dozen stages, whatever the number of edges.
DRIVER_EDGES = 20_000


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def joined(pairs: list[tuple]) -> dict:
    """The root of each node of (u, v) that is not one itself."""
    above: dict = {}

    def root(x):
        top = x
        while top in above:
            top = above[top]
        while x != top:  # the nodes on the way point to the root from now on
            above[x], x = top, above[x]
        return top

    for u, v in pairs:
        a, b = root(u), root(v)
        if a != b:
            above[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(above)}


def _local(edges: DataFrame) -> DataFrame:
    """``components`` of a few edges, found in the driver."""
    held = edges.toArrow()
    found = joined(list(zip(held.column(0).to_pylist(), held.column(1).to_pylist(), strict=True)))
    types = [("node", held.schema.field(0).type), ("root", held.schema.field(1).type)]
    rows = pa.table([pa.array(x, t) for x, (_, t) in zip((found.keys(), found.values()), types, strict=True)], pa.schema(types))
    return F.broadcast(edges.sparkSession.createDataFrame(rows, f"node {edges.schema['u'].dataType.simpleString()}, root {edges.schema['v'].dataType.simpleString()}"))


def components(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (u, v) that are not roots; the root is the least node reachable.

    Each round is two aggregates that combine before they shuffle and two joins; the edges are written to the shared
    folder after each, and rounds end when the edges stay as they are or are at most ``driver_edges``, which the driver
    joins. Null nodes and loops are left out.
    """
    edges = checkpointed(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(edges)
    while mark[0] > driver_edges:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        return _local(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
