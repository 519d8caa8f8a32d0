"""Connected components of a graph that no machine holds: alternating large-star and small-star steps over tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import drop_stored, stored


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) of longs, in any direction. Returns (node, component) for every node of an edge between two nodes; the component is its
    least node.

    A step joins every edge with the least neighbour of its end, which is an aggregate; the neighbours of a node never meet in one task, and a node
    with very many of them is a skewed side that adaptive joins split. Each step's edges are written to the shared folder; the number of steps grows with the
    logarithm of the number of nodes.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(e)
    while state[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select("a", "m", "b")
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        new = stored(small, "edges")
        drop_stored(e)
        e, before, state = new, state, _state(new)
        if state == before:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """The same for the same edges, and hardly ever for others."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(1), "a"))).first())
