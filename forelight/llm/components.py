"""Connected components of a distributed edge list by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Tables


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node of ``edges`` (u, v, any
    direction, repeats allowed).

    Each round ranks the nodes anew by a hash; every node takes the first-ranked of itself
    and its neighbours, edges move to the taken nodes, loops and repeats go, and the mapping
    so far is composed with the round's. Random ranks shrink chains and stars alike by a
    constant share a round. Nothing but a row count reaches the driver; a hub's neighbours
    are reduced to one on each task before they meet."""
    tables = Tables(edges.sparkSession)
    edges = tables.put(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct())
    mapping, turn = None, 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("rank"), F.col(c).alias("node"))  # noqa: B023, E731
        best = both.groupBy("u").agg(F.min(rank("v")).alias("m"))
        step = tables.put(best.select(F.col("u").alias("node"), F.least(rank("u"), F.col("m"))["node"].alias("to")))
        if mapping is None:
            mapping = tables.put(step.select("node", F.col("to").alias("label")))
        else:
            before = mapping
            mapping = tables.put(before.join(step.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
            tables.drop(before)
        u, v = step.select(F.col("node").alias("u"), F.col("to").alias("tu")), step.select(F.col("node").alias("v"), F.col("to").alias("tv"))
        moved = edges.join(u, "u").join(v, "v").select(F.least("tu", "tv").alias("u"), F.greatest("tu", "tv").alias("v"))
        fewer = tables.put(moved.where("u < v").distinct())
        tables.drop(edges, step)
        edges, turn = fewer, turn + 1
    if mapping is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    least = mapping.groupBy("label").agg(F.min("node").alias("least"))
    out = tables.put(mapping.join(least, "label").select("node", F.col("least").alias("label")))
    tables.drop(mapping, edges)
    return out
