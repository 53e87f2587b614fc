"""Joins of the clinical tables and of the property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_site(records: DataFrame, lookup: DataFrame, on: str = "subject") -> DataFrame:
    """Left lookup of the one site per subject (see ``features.subject_sites``)."""
    return records.join(lookup, on, "left")


def both_directions(edges: DataFrame, edge_type: str | None = None) -> DataFrame:
    """Edges as ``node, neighbour, edge_type``, once per direction."""
    if edge_type is not None:
        edges = edges.where(F.col("edge_type") == edge_type)
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), "edge_type")
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), "edge_type")
    return out.unionByName(back)


def one_hop(frontier: DataFrame, edges: DataFrame, edge_type: str | None = None) -> DataFrame:
    """Neighbours of every frontier node. The frontier is the small side; adaptive
    execution broadcasts it when measured so, and splits hub nodes otherwise."""
    return frontier.join(both_directions(edges, edge_type), "node")


def two_hop(start: DataFrame, edges: DataFrame, first: str, second: str) -> DataFrame:
    """``start(node)`` over two edge types: ``node, middle, target``."""
    one = one_hop(start, edges, first).select("node", F.col("neighbour").alias("middle"))
    step = both_directions(edges, second).select(F.col("node").alias("middle"), F.col("neighbour").alias("target"))
    return one.join(step, "middle").select("node", "middle", "target")


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every row beside the columns of a one-row aggregate."""
    return df.withColumn("_k", F.lit(1)).join(F.broadcast(one_row.withColumn("_k", F.lit(1))), "_k").drop("_k")
